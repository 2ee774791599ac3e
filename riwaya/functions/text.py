"""Scalar functions over text: snippets, marking, digits, paragraphs, evidence, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riwaya.functions.normalize import tokens_of

# ---- fixed values -------------------------------------------------------
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
#: White space as scripts in browsers and Python see it.
WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
METHOD_LABELS = {"shared_key": "مفتاح مشترك", "quotation": "اقتباس لفظي", "naming": "تسمية مُقرَّرة", "manual": "ربط مُقرَّر يدويًا"}
#: Formats of what a link rests on.
QUOTED = "يقتبس الحديث من الآية %d كلمة متتالية نصًّا: «%s». مطابقة لفظية دقيقة بعد تطبيع الرسم، لا اجتهاد فيها."
ALSO_BEFORE, ALSO_AFTER = " تنبيه: هذا اللفظ يرد أيضًا في ", " — فقد يكون المقصود موضعًا آخر. المنصة تعرض ولا ترجّح."
NAMED = "يذكر الحديث الآية باسمها «%s» دون أن يقتبس لفظها. إسناد التسمية: %s (%s)"
SHARED_KEY = "مبوَّب على الآية نفسها في %s — مفتاح مشترك %d:%d."
# -------------------------------------------------------------------------


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def snippet(text: Column, needle: Column, before: int = 45, after: int = 90) -> Column:
    """The surroundings of the first match: ``before`` and ``after`` characters; null without a match."""
    at = F.instr(text, needle)
    start = F.greatest(at - 1 - before, F.lit(0))
    body = F.substring(text, start + 1, at - 1 - start + F.length(needle) + after)
    return F.when(at > 0, F.concat(F.when(start > 0, "…").otherwise(""), body, F.lit("…")))


def signature(text: Column, needle: Column, size: int = 80) -> Column:
    at = F.instr(text, needle)
    return F.when(at > 0, F.substring(text, at, F.lit(size)))


def escape_html(c: Column, apostrophe: bool = False) -> Column:
    """Null gives ''. With ``apostrophe`` also the single quotation mark."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#x27;"),) if apostrophe else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(text: Column, needle: Column) -> Column:
    """The first match between mark tags, everything escaped."""
    at = F.instr(text, needle)
    end = at + F.length(needle)
    marked = F.concat(escape_html(F.substring(text, F.lit(1), at - 1)), F.lit("<mark>"), escape_html(F.substring(text, at, F.length(needle))), F.lit("</mark>"), escape_html(F.substring(text, end, F.length(text))))
    return F.when(at > 0, marked).otherwise(escape_html(text))


def arabic_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", ARABIC_DIGITS)


def paragraphs(c: Column) -> Column:
    """Trimmed lines that aren't empty; a dash if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), trim_white), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("—")))


def preview(c: Column, size: int = 220) -> Column:
    return F.concat(F.substring(c, 1, size), F.lit("…"))


def last_words(normal: Column, n: int = 9) -> Column:
    w = tokens_of(normal)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def quotation_evidence(quoted: Column, words: Column, also: Column) -> Column:
    """What a quotation link rests on; names the other verses that hold the words."""
    base = F.format_string(QUOTED, words, quoted)
    return F.when(F.size(also) > 0, F.concat(base, F.lit(ALSO_BEFORE), F.array_join(also, "، "), F.lit(ALSO_AFTER))).otherwise(base)


def naming_evidence(name: Column, attested: Column, source: Column) -> Column:
    return F.format_string(NAMED, name, F.coalesce(attested, F.lit("")), F.coalesce(source, F.lit("")))


def method_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in METHOD_LABELS.items() for x in kv])
    return F.coalesce(labels[c], c)


def page_or_dash(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c), F.lit("—"))


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def quote_url(c: Column) -> Column:
    """Percent encoding with %20 for a space; the slash stays."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def join_shared(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ","))


def shard(c: Column, shards: int = 24) -> Column:
    """Number of the shard of a key: the 32-bit polynomial hash with factor 31 over its UTF-16 units.

    Characters beyond the BMP count by their code point here; keys have none.
    """
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    units = F.filter(F.split(c, ""), lambda x: x != "")
    h = F.aggregate(units, F.lit(0).cast("long"), lambda acc, x: wrap(acc * 31 + F.ascii(x)))
    return (F.abs(h) % shards).cast("int")


def parse_route(c: Column) -> Column:
    """(kind, surah, ayah) of a path like /ayah/2/255 or /surah/2; null parts where the path is another."""
    part = lambda k: F.regexp_extract(c, r"^/(ayah|surah)/(\d+)(?:/(\d+))?/?$", k)
    number = lambda k: part(k).try_cast("int")
    whole = ((part(1) == "ayah") & (part(3) != "")) | ((part(1) == "surah") & (part(3) == ""))
    return F.when(whole, F.struct(part(1).alias("kind"), number(2).alias("surah"), number(3).alias("ayah")))


def parse_ref(c: Column) -> tuple[Column, Column]:
    """Both numbers of "2:255"; null where there is none."""
    parts = F.split(c, ":")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor ''."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def join_filled(separator: str, *columns: Column) -> Column:
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), separator)
