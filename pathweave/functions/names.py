"""Name and token functions (H1-H9, H12-H17), Column -> Column, JVM-side.

All of them are plain Spark SQL expressions (regexp_replace, split,
higher-order array functions), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import METHOD_NAME, NUMBERS_KEPT

# Fixed values that must equal the reference:
# numbers kept as such by the C#-style normaliser, everything else becomes NUM
CS_NUMBERS_KEPT = ("0", "1", "2", "3", "4", "5", "10")
# parent kinds after which the Java-style path carries a child index
JAVA_CHILD_ID_PARENTS = ("AssignExpr", "ArrayAccessExpr", "FieldAccessExpr", "MethodCallExpr")
# identifier split: lower->Upper, underscore, digit, acronym end, blanks
SUBTOKEN_SPLIT = r"(?<=[a-z])(?=[A-Z])|_|[0-9]|(?<=[A-Z])(?=[A-Z][a-z])|\s+"
BLANK_WORD = "BLANK"
# ASCII blanks (what both \s flavours of the extractors agree on)
JAVA_BLANKS = "[ \t\n\x0B\f\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once (lambdas and repeated array functions share no subexpressions)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize_name(x, default: str = BLANK_WORD) -> Column:
    """H1: lower; drop escaped newlines, the '//s+' pattern, quotes and commas,
    non-printables; keep letters; if none, blanks -> '_', empty -> default."""
    s = F.lower(_c(x))
    s = F.regexp_replace(s, r"\\n", "")
    s = F.regexp_replace(s, r"//s+", "")
    s = F.regexp_replace(s, "[\"',]", "")
    s = F.regexp_replace(s, r"\P{Print}", "")
    stripped = F.regexp_replace(s, "[^A-Za-z]", "")
    careful = F.replace(s, F.lit(" "), F.lit("_"))
    return (F.when(F.length(stripped) > 0, stripped)
            .when(F.length(careful) > 0, careful)
            .otherwise(F.lit(default)))


def _java_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split_subtokens(x) -> Column:
    """H2: identifier -> array of normalised subtokens (empties dropped)."""
    parts = F.split(_java_trim(_c(x)), SUBTOKEN_SPLIT, -1)
    parts = F.filter(parts, lambda p: F.length(p) > 0)
    parts = F.transform(parts, lambda p: normalize_name(p, ""))
    return F.filter(parts, lambda p: F.length(p) > 0)


def normalize_name_cs(x) -> Column:
    """H3: C#-style normaliser.

    lower; literal '\\\\n' and literal '["',]' removed; all blanks removed;
    non-ASCII removed; commas -> 'C'; letters kept; if none: a number in the
    keep list stays, other numbers -> NUM, anything else -> ''.
    """
    s = F.lower(_c(x))
    s = F.replace(s, F.lit("\\\\n"), F.lit(""))
    s = F.replace(s, F.lit("[\"',]"), F.lit(""))
    s = F.regexp_replace(s, JAVA_BLANKS, "")
    s = F.regexp_replace(s, r"[^\x00-\x7F]", "")
    s = F.replace(s, F.lit(","), F.lit("C"))

    def kept(s):
        return (F.when(s.rlike(r"^[0-9]+$") & s.isin(*CS_NUMBERS_KEPT), s)
                .when(s.rlike(r"^[0-9]+$"), F.lit("NUM"))
                .otherwise(F.lit("")))

    return _bound(s, lambda s: _bound(F.regexp_replace(s, "[^A-Za-z]", ""), lambda letters: F.when(F.length(letters) > 0, letters).otherwise(kept(s))))


def split_subtokens_cs(x) -> Column:
    """H4: the same split, each part through H3, empties dropped."""
    parts = F.split(_java_trim(_c(x)), SUBTOKEN_SPLIT, -1)
    parts = F.filter(parts, lambda p: F.length(p) > 0)
    parts = F.transform(parts, lambda p: normalize_name_cs(p))
    return F.filter(parts, lambda p: F.length(p) > 0)


def split_name_unless_empty(x) -> Column:
    """H5: subtokens joined by '|'; else H3; blank -> SPACE; METHOD_NAME unchanged."""
    x = _c(x)
    name = _bound(F.array_join(split_subtokens_cs(x), "|"), lambda j: F.when(F.length(j) > 0, j).otherwise(normalize_name_cs(x)))
    name = _bound(name, lambda n: F.when(F.length(F.regexp_replace(n, JAVA_BLANKS, "")) == 0, F.lit("SPACE")).otherwise(n))
    # one subtoken of letters only needs no split
    return F.when(x == F.lit(METHOD_NAME), x).when(x.rlike(r"\A([a-z]+|[A-Z][a-z]*|[A-Z]+)\z"), F.lower(x)).otherwise(name)


def normalize_word(x) -> Column:
    """H6: letters only, lower; if none, the lower-cased input."""
    x = _c(x)
    stripped = F.regexp_replace(x, "[^a-zA-Z]", "")
    return F.when(F.length(stripped) == 0, F.lower(x)).otherwise(F.lower(stripped))


def get_subtokens(x) -> Column:
    """H7: split at '|'."""
    return F.split(_c(x), r"\|", -1)


def java_string_hash(x) -> Column:
    """H8: 31-polynomial over the UTF-16 units, 32-bit wrap, signed (as Java's hashCode)."""
    return signed_int(hash_state(x)["h"])


def signed_int(h) -> Column:
    """An unsigned 32-bit number as int."""
    return F.when(h >= F.lit(2147483648), h - F.lit(4294967296)).otherwise(h).cast("int")


def hash_state(x) -> Column:
    """struct(h, p): the unsigned hash of a text and 31 ** (its UTF-16 units) modulo 2**32."""
    mod = F.lit(4294967296)
    codes = F.transform(F.split(_c(x), "", -1), lambda ch: F.ascii(ch).cast("long"))

    def step(acc: Column, c: Column) -> Column:
        pair = c > F.lit(65535)  # a character beyond the basic plane is two units
        high, low = F.lit(55232) + F.shiftright(c, 10), F.lit(56320) + c % F.lit(1024)
        h = F.when(pair, (acc["h"] * 31 + high) * 31 + low).otherwise(acc["h"] * 31 + c) % mod
        # split("") of a text gives one empty piece only for the empty text; its code is 0 and it has no unit
        p = F.when(pair, acc["p"] * 961).when(c == 0, acc["p"]).otherwise(acc["p"] * 31) % mod
        return F.struct(h.alias("h"), p.alias("p"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"))
    return F.aggregate(codes, start, step)


def mul32(a, b) -> Column:
    """a * b modulo 2**32 of unsigned 32-bit numbers, in two halves that stay within 64 bits."""
    a, b, mask = _c(a), _c(b), F.lit(4294967295)
    high = (a * F.shiftright(b, 16)).bitwiseAND(mask)
    return (high * 65536 + a * b.bitwiseAND(F.lit(65535))).bitwiseAND(mask)


def hash_of_concat(h_left, h_right, p_right) -> Column:
    """The unsigned hash of a + b from hash(a), hash(b) and 31 ** length(b)."""
    return (mul32(h_left, p_right) + _c(h_right)).bitwiseAND(F.lit(4294967295))


def maybe_hash_path(path, no_hash: bool = False) -> Column:
    """H9: hashed path text by default, readable on request."""
    return _c(path) if no_hash else java_string_hash(path).cast("string")


def saturate_child_id(x, cap: int | None) -> Column:
    """min(id, cap); no cap = unbounded."""
    return _c(x) if cap is None else F.least(_c(x), F.lit(cap))


def fold_numeric(x, keep: tuple[str, ...] = NUMBERS_KEPT, token: str = "<NUM>") -> Column:
    """A number outside the keep list becomes the fold token."""
    x = _c(x)
    return F.when(x.rlike(r"^[0-9]+$") & ~x.isin(*keep), F.lit(token)).otherwise(x)


def truncate_label(x, n: int = 50) -> Column:
    """At most n characters."""
    return F.substring(_c(x), 1, n)


def code_length(text) -> Column:
    """Line count of a body: CRLF -> LF, tabs -> blanks, a leading
    '{\\n' (three characters cut, as the reference does) and a closing
    '\\n}' removed; then the lines of the split (trailing empty lines
    dropped) are counted unless they start with '/' or '*' after trimming.

    The reference meant to skip brace-only and blank lines too but compared
    strings by reference, so in effect it counts them; so do we.
    """
    s = F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    s = F.when(s.startswith("{\n"), _java_trim(F.substr(s, F.lit(4)))).otherwise(s)
    s = F.when(s.endswith("\n}"), _java_trim(F.substr(s, F.lit(1), F.length(s) - 2))).otherwise(s)
    body = F.regexp_replace(s, "\n+$", "")
    lines = F.split(body, "\n", -1)
    kept = F.filter(lines, lambda ln: ~_java_trim(ln).startswith("/") & ~_java_trim(ln).startswith("*"))
    return (F.when(F.length(s) == 0, F.lit(0))
            .when(F.length(body) == 0, F.lit(0))
            .otherwise(F.size(kept))).cast("long")


def node_type_label(kind, operator=None, boxed=None, generic_leaf=None) -> Column:
    """Kind + ':' + operator for operator nodes; boxed types -> PrimitiveType;
    a generic parent counted as leaf -> GenericClass."""
    t = _c(kind)
    if boxed is not None:
        t = F.when(_c(boxed), F.lit("PrimitiveType")).otherwise(t)
    if operator is not None:
        op = _c(operator)
        t = F.when(op.isNotNull() & (F.length(op) > 0), F.concat(t, F.lit(":"), op)).otherwise(t)
    if generic_leaf is not None:
        t = F.when(_c(generic_leaf), F.lit("GenericClass")).otherwise(t)
    return t


def url_encode_name(x) -> Column:
    """URL-encoded node name."""
    return F.url_encode(_c(x))
