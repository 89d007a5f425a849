"""Cleaning of titles and descriptions as Column expressions.

Lengths and cuts count code points. White space is Unicode white space with the byte order mark, as catalogue
copy has it; Java's \\s alone would leave no-break spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space characters.
WS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Letters with marks that comparison folds, and what they fold to. É isn't among them: it only becomes é.
FOLDED, FOLDED_TO = "ăâîșşțţĂÂÎȘŞȚŢáéíóúüöñ", "aaissttAAISSTTaeiouuon"
#: Named character references that are decoded.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "eacute": "é", "agrave": "à", "uuml": "ü", "amp": "&",
}


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x written and evaluated once, however often use names it."""
    return F.transform(F.array(x), lambda v: use(v))[0]


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def sql_let(x: Column, name: str, body: str) -> Column:
    """let() with the use written in SQL, where a Column of many parts would take the driver long to build."""
    return F.call_function("transform", F.array(x), F.expr(f"{name} -> {body}"))[0]


def _bound(x: str, name: str, body: str) -> str:
    return f"transform(array({x}), {name} -> {body})[0]"


def _numbered(v: str, pattern: str, base: int) -> str:
    """SQL: references by number decoded; numbers that are no character stay as written."""
    char = "CASE WHEN point BETWEEN 0 AND 0xD7FF OR point BETWEEN 0xE000 AND 0x10FFFF THEN decode(unhex(lpad(hex(point), 8, '0')), 'UTF-32') ELSE whole END"
    for number in ("0x10FFFF", "0xD7FF", "0xE000"):
        char = char.replace(number, str(int(number, 16)))
    of = _bound(f"CASE WHEN length(digits) <= 8 THEN CAST(conv(digits, {base}, 10) AS BIGINT) END", "point", char)
    chars = f"zip_with(regexp_extract_all({v}, r'{pattern}', 1), regexp_extract_all({v}, r'{pattern}', 0), (digits, whole) -> {of})"
    return f"array_join(zip_with(split({v}, r'{pattern}', -1), {chars}, (gap, c) -> concat(gap, coalesce(c, ''))), '')"


def _named(w: str, names: list[str]) -> str:
    for name in names:
        char = NAMED_ENTITIES[name]
        w = f"regexp_replace({w}, r'(?i)&{name};', {chr(39) + char + chr(39) if char != chr(39) else chr(34) + char + chr(34)})"
    return w


def _decode_sql() -> str:
    names = [n for n in NAMED_ENTITIES if n != "amp"]
    both = _bound(_numbered("v", "(?i)&#x([0-9a-f]+);", 16), "d", _numbered("d", r"&#(\d+);", 10))
    # most texts have &amp; at most: one search rules the other names out
    rare = _bound(f"CASE WHEN contains(v, '&#') THEN {both} ELSE v END", "w", f"CASE WHEN regexp_like(w, r'(?i)&({'|'.join(names)});') THEN {_named('w', names)} ELSE w END")
    return f"CASE WHEN contains(v, '&') THEN {_named(rare, ['amp'])} ELSE v END"


DECODE_SQL = _decode_sql()


def decode_entities(x: Column) -> Column:
    """Hexadecimal, then decimal, then named references; &amp; last, so that nothing it gives is decoded again."""
    return sql_let(text_or_empty(x), "v", DECODE_SQL)


def words_column(words: list[str]) -> Column:
    """An array of words that have no line breaks, as one literal."""
    return F.split(F.lit("\n".join(words)), "\n") if words else F.array().cast("array<string>")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"[{WS}]+", " "))


def strip_tags(x: Column) -> Column:
    return decode_entities(F.regexp_replace(text_or_empty(x), "<[^>]*>", " "))


def clean_output(x: Column) -> Column:
    """Published text in plain characters."""
    x = F.translate(decode_entities(x), "–—×‘’“”", "--x''\"\"")
    return collapse(F.replace(x, F.lit("…"), F.lit("...")))


def fold_plain(x: Column) -> Column:
    """Comparison form of text without tags and references."""
    x = F.lower(F.translate(x, FOLDED, FOLDED_TO))
    return collapse(F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}{WS}-]+", " "))


def fold_sql(x: str) -> str:
    """fold_plain as SQL."""
    kept = rf"regexp_replace(lower(translate({x}, '{FOLDED}', '{FOLDED_TO}')), r'[^\p{{L}}\p{{N}}{WS}-]+', ' ')"
    return f"trim(regexp_replace({kept}, r'[{WS}]+', ' '))"


def normalize(x: Column) -> Column:
    """Comparison form: tags and marks gone, lower case, letters, digits, hyphens and single spaces only."""
    return fold_plain(strip_tags(x))


def prepare_cased(title: Column, body: Column) -> Column:
    """What patterns read: title and description as one text. Tags are stripped from the description only."""
    return collapse(F.concat(decode_entities(title), F.lit(". "), strip_tags(body)))


def prepare(title: Column, body: Column) -> Column:
    return F.lower(prepare_cased(title, body))


def first_words(x: Column, n: int) -> Column:
    """x, or its first n words and three dots."""
    return let(F.split(x, " "), lambda words: F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) <= n, "").otherwise("...")))


def first_sentence(x: Column, max_words: int) -> Column:
    clean = collapse(strip_tags(x))
    return first_words(F.split(clean, r"(?<=[.!?])\s")[0], max_words)


def yaml_escape(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))


def list_values(values: Column, most: int, n: Column | None = None) -> Column:
    """The first values, and how many more there are: of n, if values has only the first."""
    n = F.size(values) if n is None else n
    more = F.when(n > most, F.concat(F.lit(" and "), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), more)


def truncate(x: Column, most: int = 125) -> Column:
    """At most so many characters: cut three short, at the last space if it lies beyond three fifths, and three dots."""

    def shorter(cut: Column) -> Column:
        back = F.instr(F.reverse(cut), F.lit(" "))
        last = F.when(back > 0, F.length(cut) - back).otherwise(-1)  # place of the last space, from 0
        return F.concat(F.trim(F.when(last > most * 0.6, F.left(cut, last)).otherwise(cut)), F.lit("..."))

    return let(x, lambda v: F.when(F.length(v) <= most, v).otherwise(let(F.substring(v, 1, most - 3), shorter)))


def looks_like_identifier(word: Column) -> Column:
    """Hex blocks of 8 or more and alphanumerics of 16 or more, each with a digit and a letter; hyphens don't count."""

    def odd(bare: Column) -> Column:
        return bare.rlike("[0-9]") & ((bare.rlike("(?i)^[0-9a-f]{8,4096}$") & bare.rlike("(?i)[a-f]")) | (bare.rlike("(?i)^[0-9a-z]{16,}$") & bare.rlike("(?i)[a-z]")))

    return let(F.replace(F.trim(word), F.lit("-"), F.lit("")), odd)


#: Shapes of file names that cameras and tools give.
FILENAME_SHAPES = (r"(?i)^dsc[\s_-]?\d+$", r"(?i)^img[\s_-]?\d+$", r"(?i)^image[\s_-]?\d+$", r"(?i)^photo[\s_-]?\d+$", r"(?i)^p\d{6,}$", r"^\d{8,}$", r"(?i)^[a-f0-9]{8,}$", r"(?i)^(screenshot|whatsapp|untitled)")


def looks_like_filename(x: Column) -> Column:

    def odd(clean: Column) -> Column:
        shapes = clean == ""
        for shape in FILENAME_SHAPES:
            shapes = shapes | clean.rlike(shape)
        return shapes | (~clean.rlike(r"\s") & looks_like_identifier(clean))

    return let(F.regexp_replace(F.trim(x), r"(?i)\.(jpe?g|png|webp|gif|avif)$", ""), odd)


def looks_like_machine_alt(x: Column) -> Column:
    """Alt text that no person wrote, even if it isn't a file name alone."""

    def odd(v: Column) -> Column:
        token = F.exists(F.split(v, r"[\s,]+"), lambda t: t.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}") | t.rlike(r"(?i)^(photoroom|img|dsc|pxl|screenshot|whatsapp)[_-]?\d") | t.rlike(r"\d{8,}"))
        return (v != "") & (looks_like_filename(v) | v.rlike("(?i)&(#[0-9]+|#x[0-9a-f]+|[a-z]+);") | token)

    return let(F.trim(x), odd)


def profile_url(x: Column) -> Column:
    """Whether x is an absolute https address with a host."""
    return F.coalesce((F.try_parse_url(F.trim(x), F.lit("PROTOCOL")) == "https") & (F.try_parse_url(F.trim(x), F.lit("HOST")) != ""), F.lit(False))


def client_ip(*headers: Column) -> Column:
    """First address of the first header that is set."""
    return F.nullif(F.trim(F.split(F.coalesce(*headers, F.lit("")), ",")[0]), F.lit(""))


def path_handle(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def json_length(x: Column) -> Column:
    """Entries of a JSON array; 0 for anything else."""
    return F.coalesce(F.json_array_length(x), F.lit(0))
