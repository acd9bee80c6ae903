"""Character tables of the cleaning operators, and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wellspark.functions.values import let

# Greek letters and the names they are spelled with.
GREEK_SMALL = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda",
    "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi",
    "ω": "omega",
}
GREEK_CAPITAL = {
    "Α": "Alpha", "Β": "Beta", "Γ": "Gamma", "Δ": "Delta", "Ε": "Epsilon", "Ζ": "Zeta", "Η": "Eta", "Θ": "Theta", "Ι": "Iota", "Κ": "Kappa", "Λ": "Lambda",
    "Μ": "Mu", "Ν": "Nu", "Ξ": "Xi", "Ο": "Omicron", "Π": "Pi", "Ρ": "Rho", "Σ": "Sigma", "Τ": "Tau", "Υ": "Upsilon", "Φ": "Phi", "Χ": "Chi", "Ψ": "Psi",
    "Ω": "Omega",
}

# Units, letters with marks, mathematical signs, currencies and marks.
SIGNS = {
    "±": "+/-", "∓": "-/+", "×": "x", "÷": "/", "°": "deg", "℃": "C", "℉": "F", "Å": "Angstrom",
    "ñ": "n", "ë": "e", "ï": "i", "ö": "o", "ü": "u", "ā": "a", "ē": "e", "ī": "i", "ō": "o", "ū": "u",
    "∞": "infinity", "≈": "approx", "≤": "<=", "≥": ">=", "≠": "!=", "∝": "proportional", "∑": "sum", "∏": "product",
    "∫": "integral", "∂": "partial", "∇": "nabla", "√": "sqrt",
    "€": "EUR", "£": "GBP", "¥": "JPY", "©": "(c)", "®": "(R)", "™": "(TM)", "§": "section", "¶": "paragraph",
}
SCIENTIFIC = {**GREEK_SMALL, **GREEK_CAPITAL, **SIGNS}

# Raised and lowered characters, and fractions.
SUPERSCRIPTS = {
    "⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁺": "+", "⁻": "-", "⁼": "=", "⁽": "(", "⁾": ")",
    "ⁿ": "n", "ⁱ": "i", "ᵃ": "a", "ᵇ": "b", "ᶜ": "c", "ᵈ": "d", "ᵉ": "e", "ᶠ": "f", "ᵍ": "g", "ʰ": "h", "ʲ": "j", "ᵏ": "k", "ˡ": "l", "ᵐ": "m", "ᵒ": "o",
    "ᵖ": "p", "ʳ": "r", "ˢ": "s", "ᵗ": "t", "ᵘ": "u", "ᵛ": "v", "ʷ": "w", "ˣ": "x", "ʸ": "y", "ᶻ": "z",
}
SUBSCRIPTS = {
    "₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9", "₊": "+", "₋": "-", "₌": "=", "₍": "(", "₎": ")",
    "ₐ": "a", "ₑ": "e", "ₕ": "h", "ᵢ": "i", "ⱼ": "j", "ₖ": "k", "ₗ": "l", "ₘ": "m", "ₙ": "n", "ₒ": "o", "ₚ": "p", "ᵣ": "r", "ₛ": "s", "ₜ": "t", "ᵤ": "u",
    "ᵥ": "v", "ₓ": "x",
}
FRACTIONS = {
    "½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅐": "1/7", "⅛": "1/8",
    "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅑": "1/9", "⅒": "1/10",
}
NUMERIC_FORMS = {
    **{k: f"^{v}" for k, v in SUPERSCRIPTS.items()},
    **{k: f"_{v}" for k, v in SUBSCRIPTS.items()},
    **FRACTIONS,
}

# What stands for reserved characters and for symbols in readable file names.
NAME_REPLACEMENTS = {
    "<": "_lt_", ">": "_gt_", ":": "_colon_", '"': '_quote_', "/": "_slash_", '\\': '_backslash_', "|": "_pipe_", "?": "_question_", "*": "_star_",
    "+": "_plus_", "#": "_hash_", "%": "_percent_", "&": "_and_", "{": "_lbrace_", "}": "_rbrace_", "[": "_lbracket_", "]": "_rbracket_", "(": "_lparen_",
    ")": "_rparen_", "=": "_equals_", "!": "_exclamation_", "@": "_at_", "$": "_dollar_", "^": "_caret_", "`": "_backtick_", "~": "_tilde_", ";": "_semicolon_",
    "'": '_apostrophe_', " ": "_", ",": "_", ".": "_dot_", "–": "_dash_", "—": "_dash_", "…": "_ellipsis_",
}
NAME_SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "°": "deg", "±": "plusminus", "≤": "lte", "≥": "gte", "≠": "neq", "≈": "approx", "∞": "inf", "∑": "sum", "∏": "prod", "∫": "integral", "∂": "partial",
    "∇": "nabla", "√": "sqrt", "∝": "proportional", "∈": "in", "∉": "notin", "⊂": "subset", "⊃": "superset", "⊆": "subseteq", "⊇": "superseteq", "∪": "union",
    "∩": "intersection", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁰": "0", "₁": "1", "₂": "2", "₃": "3",
    "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9", "₀": "0",
}

NON_ASCII = r"[^\x00-\x7F]"


def replace_chars(text: Column, table: dict[str, str], keep_original: bool = False) -> Column:
    """Replace each character of the table; texts without any of them are passed through untouched."""
    # One wide negated class is far cheaper to match than a class listing every character.
    ordinary = "\\x00-\\x7F" if all(c > "\x7f" for c in table) else "A-Za-z0-9_"
    words = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, f"{v}({k})" if keep_original else v)])
    # A map is searched entry by entry, and most characters of their own are in no table.
    listed = F.lit("".join(table))

    def replaced(t: Column) -> Column:
        # Ordinary runs stay whole; every other character is a piece of its own.
        pieces = F.regexp_extract_all(t, F.lit(f"([{ordinary}]+|[^{ordinary}])"), F.lit(1))
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.when((F.length(x) == 1) & F.contains(listed, x), F.try_element_at(words, x)), x)), "")

    return let(text, lambda t: F.when(t.rlike(f"[^{ordinary}]"), replaced(t)).otherwise(t))


def non_ascii_chars(text: Column) -> Column:
    """All non-ASCII characters of a text, in order, by code point."""
    return F.regexp_extract_all(text, F.lit(f"({NON_ASCII})"), F.lit(1))


# Unicode general categories.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()


def category_of(char: Column) -> Column:
    """General category of a one-character text."""
    out = F.lit(None).cast("string")
    for c in reversed(CATEGORIES):
        out = F.when(char.rlike(r"^\p{" + c + "}"), c).otherwise(out)
    return out
