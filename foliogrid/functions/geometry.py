"""Boxes as SQL: each function takes the prefixes of two boxes (``a.x0`` and so on) and gives an expression both Spark and DuckDB read."""

from __future__ import annotations


def width(a: str) -> str:
    return f"({a}x1 - {a}x0)"


def height(a: str) -> str:
    return f"({a}y1 - {a}y0)"


def intersection(a: str, b: str) -> str:
    return f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0))"


def overlap_of_smaller(a: str, b: str) -> str:
    """Shared area by the smaller box's area, which counts as 1 at least."""
    return f"({intersection(a, b)} / least(greatest({width(a)} * {height(a)}, 1), greatest({width(b)} * {height(b)}, 1)))"


def iou(a: str, b: str) -> str:
    """Shared area by joint area; 0 where a box has none."""
    both = intersection(a, b)
    return f"case when {width(a)} <= 0 or {height(a)} <= 0 or {width(b)} <= 0 or {height(b)} <= 0 then 0 else {both} / ({width(a)} * {height(a)} + {width(b)} * {height(b)} - {both}) end"


def span_overlap(a: str, b: str, axis: str) -> str:
    """Shared length on an axis by the shorter one."""
    return f"(greatest(0, least({a}{axis}1, {b}{axis}1) - greatest({a}{axis}0, {b}{axis}0)) / greatest(least({a}{axis}1 - {a}{axis}0, {b}{axis}1 - {b}{axis}0), 0.000001))"


def intersects(a: str, b: str) -> str:
    return f"({a}x0 < {b}x1 and {b}x0 < {a}x1 and {a}y0 < {b}y1 and {b}y0 < {a}y1)"


def centre(a: str, axis: str) -> str:
    return f"(({a}{axis}0 + {a}{axis}1) / 2)"


def relation_hint(s: str, t: str, gap: float = 2.8, rise: float = 2.4, least_overlap: float = 0.08, scripts_first: bool = False) -> str:
    """How a target glyph lies to a source: the first rule that holds, or null. ``scripts_first``: the order of training data."""
    h = f"greatest({height(s)}, {height(t)}, 1)"
    across = f"({t}x0 - {s}x1)"
    down = f"({centre(t, 'y')} - {centre(s, 'y')})"
    x, y = span_overlap(s, t, "x"), span_overlap(s, t, "y")
    beside = f"{across} >= -{h} * 0.25 and {across} <= {h} * {gap}"
    smaller = f"greatest({height(t)}, 1) <= greatest({height(s)}, 1) * 0.92" if scripts_first else f"{height(t)} <= {height(s)} * 0.92"
    stacked = f"{x} >= {least_overlap} and abs({down}) <= {h} * {rise}"
    right = f"when {beside} and {y} >= {max(least_overlap, 0.35)} then 'right_neighbor'"
    scripts = f"""when {beside} and {smaller} and {down} < -{h} * 0.12 then 'superscript_zone'
      when {beside} and {smaller} and {down} > {h} * 0.12 then 'subscript_zone'"""
    return f"""case {scripts if scripts_first else right}
      {right if scripts_first else scripts}
      when {stacked} and {down} < -{h} * 0.35 then 'above_zone'
      when {stacked} and {down} > {h} * 0.35 then 'below_zone'
      when {stacked} then 'overlap_zone'
      when abs({across}) <= {h} * {gap} and abs({down}) <= {h} * {rise} then 'far_context' end"""


#: In what order relation hints count.
HINT_ORDER = {"right_neighbor": 0, "superscript_zone": 1, "subscript_zone": 1, "above_zone": 2, "below_zone": 2, "overlap_zone": 3, "far_context": 4}


def hint_order(x: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v}" for k, v in HINT_ORDER.items()) + " end"


def edge_features(s: str, t: str) -> dict[str, str]:
    """The 14 features of a candidate edge, by name; nodes have font, size, unknown and script besides their box."""
    h, w = f"greatest({height(s)}, {height(t)}, 1)", f"greatest({width(s)}, {width(t)}, 1)"
    return {
        "dx_over_height": f"({centre(t, 'x')} - {centre(s, 'x')}) / {h}",
        "dy_over_height": f"({centre(t, 'y')} - {centre(s, 'y')}) / {h}",
        "horizontal_gap_over_height": f"({t}x0 - {s}x1) / {h}",
        "vertical_gap_over_height": f"greatest({t}y0 - {s}y1, {s}y0 - {t}y1, 0) / {h}",
        "x_overlap": span_overlap(s, t, "x"),
        "y_overlap": span_overlap(s, t, "y"),
        "size_ratio": f"{t}size / greatest({s}size, 0.000001)",
        "width_ratio": f"{width(t)} / {w}",
        "height_ratio": f"{height(t)} / {h}",
        "same_font": f"case when {s}font <> '' and {s}font = {t}font then 1 else 0 end",
        "source_unknown": f"case when {s}unknown then 1 else 0 end",
        "target_unknown": f"case when {t}unknown then 1 else 0 end",
        "source_is_script_size": f"case when {s}script then 1 else 0 end",
        "target_is_script_size": f"case when {t}script then 1 else 0 end",
    }


def is_rule(a: str, horizontal: bool = True) -> str:
    """Whether a box is a drawn rule: six times as long as thick, and thin."""
    long, thick = (width(a), height(a)) if horizontal else (height(a), width(a))
    return f"({long} / greatest({thick}, 0.000001) >= 6 and {thick} <= greatest({long} * 0.08, 2))"


TINY = "0.000001"


def _wide(a: str) -> str:
    return f"greatest({width(a)}, {TINY})"


def _tall(a: str) -> str:
    return f"greatest({height(a)}, {TINY})"


def shared(a: str, b: str, axis: str) -> str:
    return f"greatest(0.0, least({a}{axis}1, {b}{axis}1) - greatest({a}{axis}0, {b}{axis}0))"


def flag(test: str) -> str:
    return f"case when {test} then 1.0 else 0.0 end"


def pair_features(s: str, t: str) -> dict[str, str]:
    """The 26 features of a pair, by name; nodes have node_type, font, math, ord (from 0) and nodes (of their page) besides their box."""
    sw, sh, tw, th = _wide(s), _tall(s), _wide(t), _tall(t)
    norm = f"greatest({sw}, {sh}, {tw}, {th}, 1.0)"
    dx, dy = (f"({centre(t, a)} - {centre(s, a)})" for a in "xy")
    vector = lambda a: f"{a}node_type = 'vector'"
    own = {"source": (s, sw, sh), "target": (t, tw, th)}
    out = {
        "bias": "1.0",
        "dx": f"{dx} / {norm}",
        "dy": f"{dy} / {norm}",
        "abs_dx": f"abs({dx}) / {norm}",
        "abs_dy": f"abs({dy}) / {norm}",
        "distance": f"sqrt({dx} * {dx} + {dy} * {dy}) / {norm}",
        "x_overlap": f"{shared(s, t, 'x')} / greatest({sw}, {tw})",
        "y_overlap": f"{shared(s, t, 'y')} / greatest({sh}, {th})",
        **{f"{k}_{n}": f"{v} / {norm}" for k, (_, w, h) in own.items() for n, v in (("width", w), ("height", h))},
        "size_ratio": f"least({sw} * {sh}, {tw} * {th}) / greatest({sw} * {sh}, {tw} * {th}, {TINY})",
        "same_font": flag(f"{s}font = {t}font"),
    }
    for k, (a, w, h) in own.items():
        out |= {
            f"{k}_is_math": flag(f"{a}math"),
            f"{k}_is_rule": flag(vector(a)),
            f"{k}_is_horizontal_rule": flag(f"{vector(a)} and {is_rule(a)}"),
            f"{k}_is_vertical_rule": flag(f"{vector(a)} and {is_rule(a, False)}"),
            f"{k}_aspect_ratio": f"least(1000.0, {w} / {h})",
            f"{k}_index": f"{a}ord / greatest(1.0, {a}nodes - 1)",
        }
    return out


def node_features(n: str = "") -> dict[str, str]:
    """Of a node's 39 features those that need no neighbour; the page's box is in gx0 to gy1, its mean size in mean_size."""
    w, h = f"greatest({width(n)}, 0.0)", f"greatest({height(n)}, 0.0)"
    span = {"x": f"greatest({n}gx1 - {n}gx0, {TINY})", "y": f"greatest({n}gy1 - {n}gy0, {TINY})"}
    inner = lambda a: f"greatest(0.0, least({n}{a}1, {n}g{a}1) - greatest({n}{a}0, {n}g{a}0)) / {span[a]}"
    vector = f"{n}node_type = 'vector'"
    return {
        "bias": "1.0",
        "width": w,
        "height": h,
        "area": f"{w} * {h}",
        "aspect_ratio": f"least(1000.0, {w} / greatest({h}, {TINY}))",
        "relative_width": f"{w} / {span['x']}",
        "relative_height": f"{h} / {span['y']}",
        "x_span_ratio": inner("x"),
        "y_span_ratio": inner("y"),
        "center_x": centre(n, "x"),
        "center_y": centre(n, "y"),
        "text_length": f"length({n}text) * 1.0",
        "text_is_blank": flag(f"trim({n}text) = ''"),
        "text_is_single_char": flag(f"length({n}text) = 1"),
        "is_math": flag(f"{n}math"),
        "is_rule": flag(vector),
        "is_horizontal_rule": flag(f"{vector} and {is_rule(n)}"),
        "is_vertical_rule": flag(f"{vector} and {is_rule(n, False)}"),
        "rule_aspect_ratio": f"case when {vector} then least(1000.0, {w} / greatest({h}, {TINY})) else 0.0 end",
        "font_size": f"{n}size * 1.0",
        "font_size_ratio": f"case when {n}size > 0 and {n}mean_size > 0 then {n}size / greatest({n}mean_size, {TINY}) else 0.0 end",
        "order_index": f"{n}ord / greatest(1.0, {n}nodes - 1)",
    }


def alignment(a: str, b: str) -> str:
    """How level two boxes stand: 1 at one middle, 0 a height apart."""
    return f"round(greatest(0.0, 1.0 - abs({centre(a, 'y')} - {centre(b, 'y')}) / greatest({_tall(a)}, {_tall(b)})), 6)"


def gap_in_heights(a: str, b: str) -> str:
    """The gap from a box to the next one on its right, in heights."""
    return f"round(greatest(0.0, {b}x0 - {a}x1) / greatest({_tall(a)}, {_tall(b)}), 6)"


def role_scores(v: str, b: str, c: str) -> dict[str, str]:
    """How well a drawn mark ``v`` serves a body ``b`` (and, for a fraction, what is below it, ``c``) in each of its seven roles."""
    wide, tall = f"case when {width(v)} <= 0 then 0.0 else least(1.0, {width(v)} / {_tall(v)} / 6) end", f"case when {height(v)} <= 0 then 0.0 else least(1.0, {height(v)} / {_wide(v)} / 6) end"
    along = lambda axis, least=TINY: f"{shared(v, b, axis)} / greatest({b}{axis}1 - {b}{axis}0, {least})"
    off = lambda edge: f"greatest(0.0, 1.0 - abs({centre(v, edge[0])} - {b}{edge}) / greatest(1.0, {height(b) if edge[0] == 'y' else width(b)}))"
    blend = lambda shape, span, near, weights: f"({weights[0]} * {shape} + {weights[1]} * {span} + {weights[2]} * {near})"
    level, upright = f"{width(v)} > 0", f"{height(v)} > 0"
    union = f"greatest({TINY}, greatest({b}x1, {c}x1) - least({b}x0, {c}x0))"
    across = f"greatest(0.0, least({v}x1, greatest({b}x1, {c}x1)) - greatest({v}x0, least({b}x0, {c}x0))) / {union}"
    gap = f"greatest(1.0, abs({c}y0 - {b}y1), {height(b)}, {height(c)})"
    between = f"case when {centre(v, 'y')} between least({b}y1, {c}y0) - {gap} and greatest({b}y1, {c}y0) + {gap} then 1.0 else 0.0 end"
    middle = f"greatest(0.0, 1.0 - abs({centre(v, 'y')} - ({b}y1 + {c}y0) / 2) / {gap})"
    if_level = lambda x: f"case when {level} then {x} else 0.0 end"
    edge = lambda axis: f"least(abs({v}{axis}0 - {b}{axis}0), abs({v}{axis}0 - {b}{axis}1)) / greatest(1.0, {b}{axis}1 - {b}{axis}0)"
    near = lambda axis: f"greatest(0.0, 1.0 - {edge(axis)})"
    frame = lambda least: f"case when {width(v)} <= 0 and {height(v)} <= 0 then 0.0 when {wide} >= {tall} then {blend(wide, along('x', least), near('y'), (0.40, 0.35, 0.25))} else {blend(tall, along('y', least), near('x'), (0.40, 0.35, 0.25))} end"
    common = (0.45, 0.35, 0.20)
    return {
        "fraction": if_level(blend(wide, across, f"greatest({between}, {middle})", common)),
        "radical": if_level(blend(wide, along("x"), off("y0"), common)),
        "overline": if_level(blend(wide, along("x"), off("y0"), common)),
        "underline": if_level(blend(wide, along("x"), off("y1"), common)),
        "enclosure": frame("1.0"),
        "fence": f"case when {upright} then {blend(tall, along('y'), f'greatest(0.0, 1.0 - least(abs({centre(v, 'x')} - {b}x0), abs({centre(v, 'x')} - {b}x1)) / greatest(1.0, {width(b)}))', common)} else 0.0 end",
        "matrix_border": frame(TINY),
    }
