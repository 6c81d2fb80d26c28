"""Scalar text functions as column expressions; only Unicode normalisation leaves the JVM, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vocab

CJK = "㐀-鿿"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """NFKC and case folding, once for each distinct text of a batch."""
    import unicodedata

    made = {x: unicodedata.normalize("NFKC", x).casefold() for x in s.dropna().unique()}
    return s.map(made, na_action="ignore").astype(object)


def lookup(table: dict, key: Column) -> Column:
    """A literal map as an expression; null where the key is missing."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_text(c: Column | str) -> Column:
    """Comparable text: folded, only digits, Latin letters and CJK; null reads as empty."""
    return F.regexp_replace(F.trim(nfkc_fold(F.coalesce(col(c), F.lit("")))), f"[^0-9a-z{CJK}]+", "")


def snake(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(col(c), F.lit("")))), "[^0-9a-z]+", "_"), F.lit("_"))


def semantic_family(c: Column | str) -> Column:
    return F.coalesce(lookup(vocab.EVENT_TYPE_FAMILY, snake(c)), F.lit("other"))


def entity_key(kind: Column | str, name: Column | str, key: Column | str) -> Column:
    """``kind:key`` with aliases resolved; empty where nothing names the entity."""
    raw = F.coalesce(F.nullif(normalize_text(key), F.lit("")), normalize_text(name))
    one = F.coalesce(lookup(vocab.ENTITY_ALIASES, raw), raw)
    return F.when(one == "", "").otherwise(F.concat(F.coalesce(F.nullif(normalize_text(kind), F.lit("")), F.lit("other")), F.lit(":"), one))


def short_text(c: Column | str, most: int = 600) -> Column:
    """One line without outer blanks, cut at ``most`` characters."""
    return F.substring(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "), 1, most)


def normalized_key(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(short_text(c, 160)), "[^0-9a-z一-鿿._:-]+", "_"), F.lit("_"))


def numeric_signature(c: Column) -> Column:
    """Distinct numbers with units in folded text."""
    found = F.regexp_extract_all(F.lower(c), F.lit("(" + vocab.NUMBERS + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))))


def number_kind(x: Column) -> Column:
    return (
        F.when(x.rlike(r"^(q[1-4]|[12]\d{3}(q[1-4])?)$"), "period")
        .when(x.rlike("[%％]$"), "percent")
        .when(x.rlike("bps?$"), "basis_points")
        .otherwise("amount")
    )


def numeric_conflict(a: Column, b: Column) -> Column:
    """Whether some kind of number occurs on both sides with different values."""
    kinds = [F.lit(k) for k in ("period", "percent", "basis_points", "amount")]

    def differs(kind: Column) -> Column:
        left, right = (F.array_sort(F.filter(x, lambda v: number_kind(v) == kind)) for x in (a, b))
        return (F.size(left) > 0) & (F.size(right) > 0) & (left != right)

    return F.exists(F.array(*kinds), differs)


def claim_terms(c: Column, names: Column | None = None) -> Column:
    """Latin words of three letters or more and CJK pairs and triples, without generic words and entity names."""
    text = F.lower(c)
    if names is not None:
        longest = F.array_sort(F.filter(names, lambda n: F.length(n) > 0), lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0))
        text = F.aggregate(longest, text, lambda t, n: F.replace(t, F.lower(n), F.lit(" ")))
    words = F.transform(F.regexp_extract_all(text, F.lit("([a-z][a-z0-9_-]{2,})"), F.lit(1)), lambda w: F.concat(F.lit("w:"), w))
    spans = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}})"), F.lit(1))

    def grams(width: int) -> Column:
        return F.flatten(F.transform(spans, lambda s: F.when(F.length(s) >= width, F.transform(F.sequence(F.lit(1), F.length(s) - (width - 1)), lambda i: F.concat(F.lit("c:"), F.substr(s, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))))

    generic = F.array(*[F.lit(p + w) for w in vocab.GENERIC_WORDS for p in ("w:", "c:")])
    return F.array_sort(F.array_except(F.array_distinct(F.concat(words, grams(2), grams(3))), generic))


def phases(text: Column) -> Column:
    """The phases whose words occur in a folded text."""
    found = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)), F.lit(name)) for name, words in vocab.PHASES.items()]
    return F.array_compact(F.array(*found))


def first_cue(c: Column, cues: list[str]) -> Column:
    """The first cue of the list that the text contains; null where it has none."""
    text = F.lower(c)
    return F.get(F.filter(F.array(*[F.lit(x) for x in cues]), lambda x: text.contains(x)), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def title_part(title: Column, name: Column) -> Column:
    """A title without the entity's name and without marks at its ends; the title itself if nothing is left."""
    bare = F.when(F.length(name) > 0, F.replace(title, name, F.lit(""))).otherwise(title)
    cut = F.regexp_replace(bare, r"^[\s·:：,，;；—-]+|[\s·:：,，;；—-]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.nullif(F.trim(title), F.lit("")), F.lit("事件"))


def clean_description(c: Column | str, most: int = 4000) -> Column:
    """Lines without links, tags and promotion."""
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"https?://\S+|www\.\S+", " ")
    lines = F.transform(F.split(bare, r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"#\S+", " "), r"\s+", " ")))
    kept = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.rlike("(?i)" + "|".join(vocab.PROMOTION)))
    return F.trim(F.substring(F.array_join(kept, "\n"), 1, most))


def token_estimate(c: Column | str) -> Column:
    """One for each character beyond ASCII, one for four of ASCII."""
    text = F.coalesce(col(c), F.lit(""))
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.length(text) - ascii_chars + F.floor((ascii_chars + 3) / 4).cast("int")


def urls(c: Column | str) -> Column:
    """Distinct links in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(https?://[^\s）)\]}>，,]+)"), F.lit(1)))


def preview(c: Column | str, most: int = 140) -> Column:
    line = F.replace(F.trim(col(c), F.lit(" \t\r\n")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))).otherwise(line)


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def snippet(c: Column | str, most: int = 20) -> Column:
    """The first characters of a Markdown line without its marks."""
    bare = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"^(?:[#\-*>•]\s*)+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = strip(F.regexp_replace(bare, r"[`*_]", ""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def strip_wrappers(c: Column | str) -> Column:
    """The JSON of a model's answer, without thoughts, fences and what stands around the outer braces."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(bare))
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(body)


def sanitize_markdown(c: Column | str) -> Column:
    """Without rules and date lines; outer blank lines go."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*-{3,}\s*$") & ~x.rlike(r"^\s*日期\s*[:：]\s*\d{4}[/-]\d{1,2}[/-]\d{1,2}\s*$"))
    return F.trim(F.array_join(lines, "\n"), F.lit(" \t\n"))


def mask_numbers(c: Column | str) -> Column:
    """struct(masked, numbers): numbers replaced by a mark each, in order, so that ``unmask_numbers`` restores them."""
    text = F.coalesce(col(c), F.lit(""))
    pattern = r"\d+(?:[.,]\d+)*\s?%?"
    return F.struct(F.regexp_replace(text, pattern, "\u0001").alias("masked"), F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1)).alias("numbers"))


def unmask_numbers(masked: Column) -> Column:
    parts = F.split(masked["masked"], "\u0001")
    return F.array_join(F.zip_with(parts, masked["numbers"], lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def normalize_language(c: Column | str) -> Column:
    text = F.replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), F.lit("_"), F.lit("-"))
    short = F.element_at(F.split(F.coalesce(lookup(vocab.LANGUAGES, text), text), "-"), 1)
    return F.when(text.isin(vocab.NO_LANGUAGE), None).otherwise(F.nullif(short, F.lit("")))


def contains_cjk(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(f"[{CJK}]")


def language_of_file(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^[^.]+\.([a-zA-Z-]+)\.(vtt|srt|ass)$", 1), F.lit(""))


def provider(url: Column | str) -> Column:
    u = F.lower(col(url))
    return F.when(u.rlike(r"youtube\.com|youtu\.be"), "youtube").when(u.contains("bilibili.com"), "bilibili")


def source_identity(url: Column | str) -> Column:
    """What names a source in its address: a handle, channel, user or custom name, or a space number."""
    path = F.url_decode(F.coalesce(F.regexp_extract(col(url), r"^[a-zA-Z]+://[^/]+(/[^?#]*)", 1), F.lit("")))
    found = [F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"^/(@[^/]{1,100})", r"^/channel/(UC[A-Za-z0-9_-]{10,})", r"^/user/([A-Za-z0-9._-]{1,100})", r"^/c/([A-Za-z0-9._-]{1,100})", r"^/(\d+)(?:/|$)")]
    return F.coalesce(*found)


def uuid5(namespace: str, name: Column) -> Column:
    """A name-based id (version 5) in JVM expressions."""
    import uuid

    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def deep_link(base: str, **parts: Column) -> Column:
    """A link with encoded parameters; parameters that are null are left out."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in parts.items()]))


def compose(template: Column | str, **values: Column) -> Column:
    """``{{name}}`` in a template replaced by values."""
    out = col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), v)
    return out


def required_headings(template: Column | str, marker: str = "### ") -> Column:
    return F.regexp_extract_all(col(template), F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))


def brief_errors(body: Column, headings: Column, sources: Column, least: int = 200) -> Column:
    """Codes of what a written brief violates, in a fixed order; null lists are empty."""
    text = F.trim(F.coalesce(body, F.lit("")))
    headings, sources = (F.coalesce(x, F.array().cast("array<string>")) for x in (headings, sources))
    missing = F.transform(F.filter(headings, lambda h: ~F.exists(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^##\s+", "##")) == F.concat(F.lit("##"), h))), lambda h: F.concat(F.lit("missing_heading:"), h))
    own = urls(text)
    cited = F.exists(sources, lambda u: text.contains(u))
    codes = F.array_compact(F.array(
        F.when(F.length(text) < least, F.lit("too_short")),
        F.when(~text.rlike(r"(?m)^##\s+"), F.lit("no_heading")),
        F.when((F.size(sources) > 0) & ~cited, F.lit("no_source")),
        F.when((F.size(sources) > 0) & (F.size(F.array_except(own, sources)) > 0), F.lit("foreign_source")),
    ))
    return F.concat(codes, missing)
