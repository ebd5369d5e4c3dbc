"""Mathematical characters as LaTeX."""

from __future__ import annotations

from foliogrid.functions.text import literal

#: Characters that LaTeX reads as something else, and how they are written.
ESCAPES = {
    "\\": r"\backslash{}",
    "{": r"\{",
    "}": r"\}",
    "_": r"\_",
    "^": r"\^{}",
    "#": r"\#",
    "$": r"\$",
    "%": r"\%",
    "&": r"\&",
}
#: Characters by their commands.
COMMANDS = {
    "−": "-",
    "·": r"\cdot",
    "×": r"\times",
    "÷": r"\div",
    "±": r"\pm",
    "∓": r"\mp",
    "∗": r"\ast",
    "⋆": r"\star",
    "√": r"\sqrt",
    "∑": r"\sum",
    "∏": r"\prod",
    "∫": r"\int",
    "∮": r"\oint",
    "∞": r"\infty",
    "∂": r"\partial",
    "∇": r"\nabla",
    "∀": r"\forall",
    "∃": r"\exists",
    "∅": r"\emptyset",
    "∈": r"\in",
    "∉": r"\notin",
    "∋": r"\ni",
    "⊂": r"\subset",
    "⊃": r"\supset",
    "⊆": r"\subseteq",
    "⊇": r"\supseteq",
    "⊊": r"\subsetneq",
    "⊋": r"\supsetneq",
    "∪": r"\cup",
    "∩": r"\cap",
    "∧": r"\wedge",
    "∨": r"\vee",
    "¬": r"\neg",
    "→": r"\to",
    "←": r"\leftarrow",
    "↔": r"\leftrightarrow",
    "⇒": r"\Rightarrow",
    "⇐": r"\Leftarrow",
    "⇔": r"\Leftrightarrow",
    "≤": r"\leq",
    "≥": r"\geq",
    "≠": r"\neq",
    "≈": r"\approx",
    "≃": r"\simeq",
    "≅": r"\cong",
    "≡": r"\equiv",
    "∼": r"\sim",
    "∝": r"\propto",
    "⊕": r"\oplus",
    "⊗": r"\otimes",
    "⊥": r"\perp",
    "∥": r"\parallel",
    "ℓ": r"\ell",
    "ℏ": r"\hbar",
    "ℵ": r"\aleph",
    "ı": r"\imath",
    "ȷ": r"\jmath",
    "α": r"\alpha",
    "β": r"\beta",
    "γ": r"\gamma",
    "δ": r"\delta",
    "ϵ": r"\epsilon",
    "ε": r"\varepsilon",
    "ζ": r"\zeta",
    "η": r"\eta",
    "θ": r"\theta",
    "ϑ": r"\vartheta",
    "ι": r"\iota",
    "κ": r"\kappa",
    "λ": r"\lambda",
    "μ": r"\mu",
    "ν": r"\nu",
    "ξ": r"\xi",
    "π": r"\pi",
    "ϖ": r"\varpi",
    "ρ": r"\rho",
    "ϱ": r"\varrho",
    "σ": r"\sigma",
    "ς": r"\varsigma",
    "τ": r"\tau",
    "υ": r"\upsilon",
    "φ": r"\phi",
    "ϕ": r"\varphi",
    "χ": r"\chi",
    "ψ": r"\psi",
    "ω": r"\omega",
    "Γ": r"\Gamma",
    "Δ": r"\Delta",
    "Θ": r"\Theta",
    "Λ": r"\Lambda",
    "Ξ": r"\Xi",
    "Π": r"\Pi",
    "Σ": r"\Sigma",
    "Υ": r"\Upsilon",
    "Φ": r"\Phi",
    "Ψ": r"\Psi",
    "Ω": r"\Omega",
    "Ω": r"\Omega",
}
SPELLED = ESCAPES | COMMANDS


def spelled(x: str) -> str:
    """A text with each character of the tables as LaTeX; letters and digits of ASCII are not looked up."""
    known = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in SPELLED.items())
    return f"array_join(transform(split({x}, ''), c -> if(c rlike '^[A-Za-z0-9 ]?$', c, coalesce(element_at(map({known}), c), c))), '')"
