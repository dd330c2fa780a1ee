"""Lexical code metrics of a source text.

Comments and literals are blanked, the rest is cut into tokens, and constructs
are recognised from neighbouring tokens: every token becomes one character that
says what it can be part of, and patterns run over that short text. The values
approximate counts over a syntax tree; they exist for any text, also one that
would not parse. All of it is local to the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import count_lines, count_pattern, line_count, or_empty

W = K.WORD_CHAR

# Escaped pairs go first, so that a literal ends at the next quote. An unclosed
# block comment runs to the end of the text.
ESCAPED_PAIR = r"\\[^\n]"
COMMENT_OR_LITERAL = r"""(?=[/"'])(?:/\*[\s\S]*?(?:\*/|\z)|//[^\n\r]*|"[^"\n]*"|'[^'\n]*')"""
BLANKS = r"[ \t\n\r\f\x0B]*+"  # before a token, so that they are not tried as one
TOKEN = (
    rf"({W}+|[(){{}}\[\];,.]|>>>=|<<=|>>=|>>>|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|->|::"
    r"|[^ \t\n\r\f\x0B])"
)

BINARY_OPERATORS = (
    "+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", "||",
    "&", "|", "^", "<<", ">>", ">>>", "instanceof",
)
# The character of a token in the shape of a text. These tokens stand for themselves.
SINGLE = ("(", ")", "{", "}", "[", "]", ";", ",", ".", "=", "<", "^", "?")
KINDS = {
    "a": ("if",),
    "b": ("for", "while"),
    "c": ("do",),
    "d": ("try",),
    "e": ("catch",),
    "f": ("return",),
    "g": ("switch",),
    "h": ("case",),
    "i": ("else",),
    "j": ("finally",),
    "k": ("synchronized", "super", "this"),
    "l": ("throw", "assert"),
    "m": ("new",),
    "n": ("instanceof",),
    "o": ("package", "import", "break", "continue", "goto", "extends", "implements"),
    "p": ("null",),
    "q": ("class",),
    "r": ("throws",),
    "B": ("+", "-", "*", "/", "%", "<=", ">=", "&", "|", "<<"),
    "D": ("&&", "||"),
    "E": ("==", "!="),
    "G": (">", ">>", ">>>"),
    "S": ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="),
    "A": ("->",),
    "O": ("!", ":", "::", "++", "--"),
}
NAME, NUMBER, OTHER = "x", "0", "z"  # any other word that begins with a letter or not, and the rest
NAMES = "a-rx"
WORDS = "a-rx0"
CALLABLE = "jo-rx0"  # words that can be called or declared before "("
NOT_A_TYPE = "fhil-o"  # words that can stand before "name =" or "name ;" without being a type
BINARY = "BDEGn<^"
BLOCK = "abcdegij"  # words that open a block
RESERVED = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
    "const", "continue", "default", "do", "double", "else", "enum", "extends", "final",
    "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
    "interface", "long", "native", "new", "package", "private", "protected", "public",
    "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "try", "void", "volatile", "while", "true", "false", "null",
)


def tokens(code: Column) -> Column:
    code = or_empty(code)
    bare = F.when(F.contains(code, F.lit("\\")), F.regexp_replace(code, ESCAPED_PAIR, " ")).otherwise(code)
    bare = F.regexp_replace(bare, COMMENT_OR_LITERAL, " ")
    return F.regexp_extract_all(bare, F.lit(BLANKS + TOKEN), F.lit(1))


def _kind(t: Column) -> Column:
    """The character of a token in the shape; plain words are told by their first character."""
    marked = F.when(t.isin(*SINGLE), t)
    for kind, items in KINDS.items():
        marked = marked.when(t.isin(*items), kind)
    small, large, digit = (t >= "a") & (t < "{"), (t >= "A") & (t < "["), (t >= "0") & (t < ":")
    word = F.when(small | large | t.startswith("_"), NAME).when(digit, NUMBER).when(t < "\x80", OTHER)
    word = word.when(t.rlike(r"\A\p{L}"), NAME).when(t.rlike(r"\A\p{N}"), NUMBER).otherwise(OTHER)
    every = [*SINGLE, *[item for items in KINDS.values() for item in items]]
    return F.when(t.isin(*every), marked).otherwise(word)


def shape(toks: Column) -> Column:
    """One character for each token, in order."""
    return F.array_join(F.transform(toks, _kind), "")


def _count(text: Column, kinds: str) -> Column:
    return count_pattern(text, f"[{kinds}]")


def _declarators(text: Column, ends: str) -> Column:
    """Names after a type and before one of ``ends``."""
    typed = count_pattern(text, rf"(?<=[{WORDS}GA\]])[{NAMES}](?=[{ends}])")
    not_typed = count_pattern(text, rf"[{NOT_A_TYPE}][{NAMES}](?=[{ends}])")
    return typed - not_typed


def _ternaries(text: Column) -> Column:
    return count_pattern(text, r"(?<![<,])\?")


def construct_counts(text: Column) -> dict[str, Column]:
    """Construct counts from a :func:`shape`."""
    methods = count_pattern(text, rf"(?<=[{WORDS}GA\]])(?<!m)[{CALLABLE}]\([^()]*\)(?:r[{WORDS}.,]+)?\{{")
    calls = count_pattern(text, rf"[{CALLABLE}](?=\()") - count_pattern(text, rf"m[{CALLABLE}](?=\()")
    elements = count_pattern(text, rf"(?<=[{WORDS})\]])\[(?=[^\]])")
    new_arrays = count_pattern(text, rf"m[{WORDS}]\[(?=[^\]])")
    return {
        "methods": methods,
        "ifs": _count(text, "a"),
        "loops": _count(text, "b"),
        "tries": _count(text, "d"),
        "catches": _count(text, "e"),
        "variables": _declarators(text, "=;"),
        "return_statements": _count(text, "f"),
        "method_invocations": calls - methods,
        "binary_operations": _count(text, BINARY),
        "null_checks": count_pattern(text, r"(?<=p)E|E(?=p)"),
        "assignments": _count(text, "=S") - _declarators(text, "="),
        "classes": count_pattern(text, r"(?<!\.)q"),
        "switch_statements": _count(text, "g"),
        "ternary_expressions": _ternaries(text),
        "array_accesses": elements - new_arrays,
        "cast_expressions": count_pattern(text, rf"(?<=[=(,BDEGSAO?<f])\([{NAMES}](?:\[\])?\)(?=[{WORDS}(])"),
    }


def cyclomatic(text: Column) -> dict[str, Column]:
    """Decision points + 1; the narrow form does not count do-loops."""
    points = _count(text, "abehD") + _ternaries(text)
    return {
        "complexity": points + 1,
        "complexity_without_do": points + 1 - count_pattern(text, r"c(?=\{)"),
    }


def nesting_depth(text: Column) -> Column:
    """Deepest nesting of braces that belong to a control structure, from a :func:`shape`.

    A brace belongs to one when a block word came after the last brace or
    statement end; a semicolon inside parentheses is no statement end. A closing
    brace ends the block it matches; unmatched ones are ignored.
    """
    events = F.regexp_extract_all(text, F.lit(rf"[{BLOCK}(){{}};]"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("parens"),
        F.lit(False).alias("pending"),
        F.lit("").alias("open"),  # one digit per open brace, 1 for a control block
        F.lit(0).alias("depth"),
        F.lit(0).alias("best"),
    )

    def step(s: Column, t: Column) -> Column:
        opens, closes = t == "{", t == "}"
        brace = opens | closes
        parens = F.when(brace, 0).when(t == "(", s["parens"] + 1).when(t == ")", s["parens"] - 1)
        pending = F.when(brace | ((t == ";") & (s["parens"] <= 0)), False).when(t.isin(*BLOCK), True)
        depth = F.when(opens & s["pending"], s["depth"] + 1).when(
            closes & F.endswith(s["open"], F.lit("1")), s["depth"] - 1
        )
        pushed = F.concat(s["open"], F.when(s["pending"], "1").otherwise("0"))
        popped = F.substring(s["open"], F.lit(1), F.greatest(F.char_length(s["open"]) - 1, F.lit(0)))
        depth = F.coalesce(depth, s["depth"])
        return F.struct(
            F.coalesce(parens, s["parens"]).alias("parens"),
            F.coalesce(pending, s["pending"]).alias("pending"),
            F.when(opens, pushed).when(closes, popped).otherwise(s["open"]).alias("open"),
            depth.alias("depth"),
            F.greatest(s["best"], depth).alias("best"),
        )

    return F.aggregate(events, start, step, lambda s: s["best"]).cast("long")


def halstead(distinct: Column) -> dict[str, Column]:
    """Distinct binary operators and names, from the distinct tokens."""
    operators = F.size(F.filter(distinct, lambda t: t.isin(*BINARY_OPERATORS))).cast("long")
    names = F.size(F.filter(distinct, lambda t: t.rlike(r"\A[\p{L}_]") & ~t.isin(*RESERVED))).cast("long")
    return {"unique_operators": operators, "unique_names": names}


def volume(vocabulary: Column) -> Column:
    return F.when(vocabulary > 1, vocabulary * F.log2(vocabulary.cast("double"))).otherwise(0.0)


def size_counts(code: Column) -> dict[str, Column]:
    """Lines, and lines with a visible character."""
    visible = rf"[^{K.SPACE_CLASS}]"
    return {
        "lines_of_code": line_count(code),
        "non_empty_lines": count_lines(code, lambda line: line.rlike(visible)),
        "is_blank": ~or_empty(code).rlike(visible),
    }
