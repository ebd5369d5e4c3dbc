"""What a training row lacks: reasons, buckets and tags as expressions over typed columns, for either dialect."""

from __future__ import annotations

#: Kinds, domains and documents that take another route, and tags that a data set should cover.
UNSUPPORTED_KINDS, UNSUPPORTED_DOMAINS = ("algorithm_block", "diagram"), ("possible_chemistry", "diagram")
IMAGE_KINDS, IMAGE_DOCUMENTS = ("image_formula", "scanned_formula", "diagram"), ("scanned", "image_only")
LEAST_HARD = 0.70
QUALITY = {"high": 0.90, "medium": 0.70}
ROUTES = {"needs_image_mfr": "image_mfr", "route_unsupported": "unsupported", "needs_identity_repair": "cloud_review", "abstain": "unsupported"}


class Spark:
    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if items else "cast(array() as array<string>)"

    def kept(self, *items: str) -> str:
        return f"array_compact({self.array(*items)})"

    def sorted_set(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"

    def joined(self, a: str) -> str:
        return f"array_join({a}, ',')"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def those(self, a: str, test: str) -> str:
        return f"filter({a}, x -> {test})"

    def each(self, a: str, to: str) -> str:
        return f"transform({a}, x -> {to})"

    def starts(self, x: str, p: str) -> str:
        return f"startswith({x}, '{p}')"

    def ends(self, x: str, p: str) -> str:
        return f"endswith({x}, '{p}')"

    def thousandths(self, x: str) -> str:
        return f"format_string('%.3f', {x})"

    def size(self, a: str) -> str:
        return f"size({a})"


class Duck(Spark):
    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if items else "[]::varchar[]"

    def kept(self, *items: str) -> str:
        return f"list_filter({self.array(*items)}, lambda v: v is not null)"

    def sorted_set(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def joined(self, a: str) -> str:
        return f"array_to_string({a}, ',')"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def those(self, a: str, test: str) -> str:
        return f"list_filter({a}, lambda x: {test})"

    def each(self, a: str, to: str) -> str:
        return f"list_transform({a}, lambda x: {to})"

    def starts(self, x: str, p: str) -> str:
        return f"starts_with({x}, '{p}')"

    def ends(self, x: str, p: str) -> str:
        return f"suffix({x}, '{p}')"

    def thousandths(self, x: str) -> str:
        return f"printf('%.3f', {x})"

    def size(self, a: str) -> str:
        return f"len({a})"


def _in(x: str, values) -> str:
    return f"{x} in ({', '.join(repr(v) for v in values)})"


def _when(test: str, value: str) -> str:
    return f"case when {test} then {value} end"


def reasons(d: Spark, least_hard: float = LEAST_HARD) -> dict[str, str]:
    """Sorted reasons by side, over candidate_kind, domain, document_kind, recommended_route, needs_ocr, target_warnings, artifacts (reasons of a tree's artifacts), aligned,
    hard_rate, unmatched, alignment_warnings. Kinds, domains and routes are in lower case."""
    route = d.kept(_when(_in("candidate_kind", UNSUPPORTED_KINDS), "'route_candidate_kind:' || candidate_kind"), _when(_in("domain", UNSUPPORTED_DOMAINS), "'route_domain:' || domain"), _when("recommended_route = 'unsupported'", "'route_metadata:unsupported'"))
    image = d.kept(_when(_in("candidate_kind", IMAGE_KINDS), "'image_candidate_kind:' || candidate_kind"), _when(_in("document_kind", IMAGE_DOCUMENTS), "'image_document_kind:' || document_kind"), _when("needs_ocr", "'needs_ocr'"))
    odd = f"{d.starts('x', 'target_tree_unsupported_katex_type')} or {d.ends('x', '_missing_body')} or {d.ends('x', '_missing_base')}"
    schema = d.concat(d.those("target_warnings", odd), d.each(d.those("artifacts", d.starts("x", "unsupported")), "'unsupported_target_artifact:' || x"), d.each(d.those("artifacts", "x = 'katex_error_color'"), "'katex_error_color_node'"))
    found = d.concat(d.kept(_when(f"hard_rate < {least_hard}", f"'hard_alignment_rate_below_min:' || {d.thousandths('hard_rate')}"), _when("unmatched > 0", "'unmatched_target_nodes'")), d.those("alignment_warnings", d.starts("x", "alignment_")))
    identity = f"case when not aligned then {d.array(repr('alignment_row_missing'))} else {found} end"
    return {"route_reasons": d.sorted_set(route), "image_reasons": d.sorted_set(image), "schema_reasons": d.sorted_set(schema), "identity_reasons": d.sorted_set(identity)}


def _some(d: Spark, name: str) -> str:
    return f"{d.size(name)} > 0"


def bucket(d: Spark) -> str:
    """Where a row belongs: the first that holds. Over the reasons' columns, latex, has_tree, target_warnings and has_glyphs."""
    return f"""case when {_some(d, 'route_reasons')} then 'route_unsupported' when {_some(d, 'image_reasons')} then 'needs_image_mfr' when trim(latex) = '' then 'abstain'
      when not has_tree then case when {_some(d, 'target_warnings')} then 'needs_schema_extension' else 'abstain' end when {_some(d, 'schema_reasons')} then 'needs_schema_extension'
      when not has_glyphs then 'abstain' when {_some(d, 'identity_reasons')} then 'needs_identity_repair' else 'ready_for_model' end"""


def bucket_reasons(d: Spark) -> str:
    """The reasons of a row's bucket."""
    one = lambda x: d.array(f"'{x}'")
    return d.sorted_set(f"""case when {_some(d, 'route_reasons')} then route_reasons when {_some(d, 'image_reasons')} then image_reasons when trim(latex) = '' then {one('missing_latex_label')}
      when not has_tree then case when {_some(d, 'target_warnings')} then target_warnings else {one('missing_target_tree')} end when {_some(d, 'schema_reasons')} then schema_reasons
      when not has_glyphs then {one('missing_pdf_glyph_nodes')} else identity_reasons end""")


def secondary(d: Spark) -> str:
    """All buckets that a row could be in but for the order."""
    names = {"route_reasons": "route_unsupported", "image_reasons": "needs_image_mfr", "schema_reasons": "needs_schema_extension", "identity_reasons": "needs_identity_repair"}
    return d.sorted_set(d.kept(*[_when(_some(d, k), f"'{v}'") for k, v in names.items()], _when("not has_glyphs", "'abstain'")))


def blocker_tags(d: Spark) -> str:
    """What blocks a row, by bucket (column ``bucket``), reasons and what its parse tree holds (has_sqrt, has_fraction, has_text, has_atom)."""
    any_of = lambda a, test: f"{d.size(d.those(a, test))} > 0"
    both = d.concat("schema_reasons", "target_warnings")
    ids = d.concat("identity_reasons", "alignment_warnings")
    repair = "bucket = 'needs_identity_repair'"
    tags = {
        "route_metadata": _some(d, "route_reasons"),
        "image_or_scanned": _some(d, "image_reasons"),
        "missing_pdf_glyphs": "not has_glyphs",
        "target_parser_failure": any_of(both, d.starts("x", "katex_parse_error")),
        "target_linebreak_or_alignment": any_of(both, "contains(x, 'unsupported_katex_type:cr')"),
        "target_builder_unsupported": f"({any_of(both, d.starts('x', 'target_tree_unsupported_katex_type'))} or {any_of('schema_reasons', d.starts('x', 'unsupported_target_artifact'))})",
        "pdf_to_target_alignment": _some(d, "identity_reasons"),
        "low_hard_alignment": any_of(ids, "x = 'alignment_low_hard_coverage'"),
        "unmatched_target_identity": any_of(ids, "contains(x, 'unmatched_target')"),
        "identity_radical_or_rule": f"{repair} and has_sqrt",
        "identity_fraction_layout": f"{repair} and has_fraction",
        "identity_text_run": f"{repair} and has_text",
        "identity_operator_or_punctuation": f"{repair} and has_atom",
    }
    listed = d.sorted_set(d.kept(*[_when(test, f"'{tag}'") for tag, test in tags.items()]))
    return f"case when bucket = 'ready_for_model' then {d.array()} else {listed} end"


def quality() -> str:
    return f"case when not has_glyphs then 'low' {' '.join(f'''when hard_rate >= {v} then '{k}' ''' for k, v in QUALITY.items())} else 'low' end"


def recommended() -> str:
    return f"case bucket {' '.join(f'''when '{k}' then '{v}' ''' for k, v in ROUTES.items())} else 'pdf_graph' end"


def row_blockers(d: Spark) -> str:
    """Why a captured row is kept out of a data set: over exact_box, quality_version, wanted_version, upstream (blockers so far), label, has_box, nodes."""
    own = d.kept(_when("not coalesce(exact_box, false)", "'not_verified_exact_box'"), _when("coalesce(quality_version, '') <> wanted_version", "'capture_quality_not_verified'"))
    rest = d.kept(_when("trim(coalesce(label, '')) = ''", "'missing_label_latex'"), _when("not coalesce(has_box, false)", "'missing_or_invalid_bbox'"), _when("nodes = 0", "'empty_graph_nodes'"))
    return d.concat(own, d.each(d.those("upstream", "x <> ''"), "'upstream:' || x"), rest)


#: Tags that a training set should cover.
WANTED_TAGS = "symbol text_run sequence group spacing_artifact script prescript under_over accent_annotation fraction radical fence enclosure matrix_grid aligned_display equation_tag operator style_variant mathvariant font_identity".split()
