"""Text, time, vector, array and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import chunking as C
from tidemark.functions import json as J
from tidemark.functions import text as X
from tidemark.functions import times as D
from tidemark.functions import vectors as V
from tidemark.functions import vocab
from tidemark.plans.registry import Catalog
from tidemark.sources.tables import table

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").select("event_id", "title", "summary", "event_type", "start_day", "end_day").distinct()


@query()
def tx01_normalized_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha2(X.normalize_text("text"), 256).alias("sha"))


FAMILY_SQL = " ".join(f"WHEN t = '{kind}' THEN '{family}'" for kind, family in vocab.EVENT_TYPE_FAMILY.items())


@query(f"SELECT family, count(*) AS n FROM (SELECT CASE {FAMILY_SQL} ELSE 'other' END AS family FROM (SELECT trim(regexp_replace(lower(trim(coalesce(event_type, ''))), '[^0-9a-z]+', '_', 'g'), '_') AS t FROM event_record)) GROUP BY 1")
def tx02_semantic_family(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").groupBy(X.semantic_family("event_type").alias("family")).agg(F.count("*").alias("n"))


_PLAIN = "regexp_replace(lower(trim(coalesce({}, ''))), '[^0-9a-z㐀-鿿]+', '', 'g')"
_ALIAS = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in vocab.ENTITY_ALIASES.items())


@query(f"""WITH e AS (SELECT DISTINCT e.entity_type, e.name, e.key FROM (SELECT unnest(entities) AS e FROM event_record)), r AS (SELECT *, coalesce(nullif({_PLAIN.format('key')}, ''), {_PLAIN.format('name')}) AS raw FROM e)
SELECT entity_type, name, key, CASE WHEN raw = '' THEN '' ELSE coalesce(nullif({_PLAIN.format('entity_type')}, ''), 'other') || ':' || CASE raw {_ALIAS} ELSE raw END END AS entity_key FROM r""")
def tx03_entity_keys(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_record").select(F.explode("entities").alias("e")).select("e.entity_type", "e.name", "e.key").distinct()
    return e.select("entity_type", "name", "key", X.entity_key("entity_type", "name", "key").alias("entity_key"))


@query(r"SELECT event_id, trim(regexp_replace(lower(left(regexp_replace(regexp_replace(coalesce(title, ''), '[\t-\r\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), 160)), '[^0-9a-z一-鿿._:-]+', '_', 'g'), '_') AS k FROM (SELECT DISTINCT event_id, title FROM event_record)")
def tx04_normalized_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").select("event_id", "title").distinct().select("event_id", X.normalized_key("title").alias("k"))


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace(coalesce(text, ''), '[\t-\r\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), 600) AS line FROM documents")
def tx05_short_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.short_text("text", 600).alias("line"))


def numbers_sql(text: str) -> str:
    """The signature of a text in SQL whose expressions know no look-around: every character that may border a number is
    doubled, so that a match can take one of the two and leave the other to its neighbour."""
    inner = vocab.NUMBERS.removeprefix("(?<![a-z0-9_])").removesuffix("(?![a-z0-9_])").replace(r"\.", r"\.\.")
    wide = sorted({c for c in inner if c in "%％" or "\u3400" <= c <= "\u9fff"})
    for c in wide:
        inner = inner.replace(c, c * 2)
    doubled = f"regexp_replace(lower({text}), '([^a-z0-9_])', '\\1\\1', 'g')"
    found = f"regexp_extract_all({doubled}, '(?:^|[^a-z0-9_])({inner})(?:$|[^a-z0-9_])', 1)"
    one = "regexp_replace(x, '\\s+', '', 'g')"
    for c in ["..", *[c * 2 for c in wide]]:
        one = f"replace({one}, '{c}', '{c[0]}')"
    return f"list_sort(list_distinct(list_transform({found}, lambda x: {one})))"


def conflict_sql(a: str, b: str) -> str:
    """Whether two signatures differ in some kind of number that both have."""
    kinds = {"period": "regexp_full_match(x, 'q[1-4]|[12]\\d{3}(q[1-4])?')", "percent": "regexp_matches(x, '[%％]$')", "basis": "regexp_matches(x, 'bps?$')"}
    kinds["amount"] = "NOT (" + " OR ".join(kinds.values()) + ")"
    of = lambda s, test: f"list_filter({s}, lambda x: {test})"
    return " OR ".join(f"(len({of(a, t)}) > 0 AND len({of(b, t)}) > 0 AND {of(a, t)} <> {of(b, t)})" for t in kinds.values())


@query(f"SELECT event_id, {numbers_sql(chr(39).join(['concat_ws(', ' ', ', title, summary)']))} AS numbers FROM (SELECT DISTINCT event_id, title, summary, event_type, start_day, end_day FROM event_record)")
def tx06_numeric_signature(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return r.select("event_id", X.numeric_signature(F.concat_ws(" ", "title", "summary")).alias("numbers"))


@query(f"SELECT event_id, {conflict_sql('a', 'b')} AS conflict FROM (SELECT event_id, {numbers_sql('title')} AS a, {numbers_sql('summary')} AS b FROM (SELECT DISTINCT event_id, title, summary, event_type, start_day, end_day FROM event_record))")
def tx07_numeric_conflict(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return r.select("event_id", X.numeric_conflict(X.numeric_signature(F.col("title")), X.numeric_signature(F.col("summary"))).alias("conflict"))


@query("SELECT event_type, direction, start_day, end_day, count(DISTINCT event_id) AS n FROM event_record GROUP BY ALL HAVING count(DISTINCT event_id) > 1")
def tx08_exact_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Records that agree in type, direction and days; with the title none on the test tables do."""
    key = ["event_type", "direction", "start_day", "end_day"]
    return table(s, d, "event_record").groupBy(*key).agg(F.countDistinct("event_id").alias("n")).where("n > 1")


_GENERIC = ", ".join(f"'{p}{w}'" for w in vocab.GENERIC_WORDS for p in ("w:", "c:"))


def claim_terms_sql(source: str, name: str) -> str:
    """CTEs that end in ``name`` (event_id, terms) for texts in ``source`` (event_id, t in lower case, names)."""
    return f"""{name}_n AS (SELECT event_id, t, list_transform(list_sort(list_transform(list_filter(coalesce(names, []), lambda x: length(x) > 0), lambda x, i: {{'n': -length(x), 'i': i, 'x': x}})), lambda s: s.x) AS names FROM {source}),
{name}_c AS (SELECT event_id, list_reduce(names, lambda a, x: replace(a, lower(x), ' '), t) AS t FROM {name}_n),
{name}_g AS (SELECT event_id, list_transform(regexp_extract_all(t, '[a-z][a-z0-9_-]{{2,}}'), lambda w: 'w:' || w) AS words, regexp_extract_all(t, '[㐀-鿿]{{2,}}') AS spans FROM {name}_c),
{name} AS (SELECT event_id, list_sort(list_filter(list_distinct(words || flatten(list_transform(spans, lambda s: list_transform(range(1, length(s)), lambda i: 'c:' || substr(s, i, 2)))) || flatten(list_transform(spans, lambda s: list_transform(range(1, length(s) - 1), lambda i: 'c:' || substr(s, i, 3))))), lambda x: x NOT IN ({_GENERIC}))) AS terms FROM {name}_g)"""


@query(f"WITH r AS (SELECT event_id, lower(concat_ws(' ', any_value(title), any_value(summary))) AS t, any_value(list_transform(entities, lambda e: e.name)) AS names FROM event_record GROUP BY 1), {claim_terms_sql('r', 'o')} SELECT event_id, terms FROM o")
def tx09_claim_terms(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").select("event_id", "title", "summary", F.col("entities.name").alias("names")).dropDuplicates(["event_id"])
    return r.select("event_id", X.claim_terms(F.concat_ws(" ", "title", "summary"), F.coalesce("names", F.array().cast("array<string>"))).alias("terms"))


PHASES_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in vocab.PHASES.items())


@query(f"SELECT event_id, list_filter([{PHASES_SQL}], lambda p: p IS NOT NULL) AS phases FROM (SELECT DISTINCT event_id, lower(concat_ws(' ', title, summary)) AS x, event_type, start_day, end_day FROM event_record)")
def tx10_phases(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).withColumn("folded", X.nfkc_fold(F.concat_ws(" ", "title", "summary")))
    return r.select("event_id", X.phases(F.col("folded")).alias("phases"))


@query(f"SELECT event_id, list_filter({[*dict.fromkeys(vocab.RESPONSE_CUES)]!r}, lambda x: contains(lower(concat_ws(' ', title, summary)), x))[1] AS cue FROM (SELECT DISTINCT event_id, title, summary FROM event_record)")
def tx11_first_cue(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").select("event_id", "title", "summary").distinct()
    return r.select("event_id", X.first_cue(F.concat_ws(" ", "title", "summary"), list(dict.fromkeys(vocab.RESPONSE_CUES))).alias("cue"))


@query(r"""SELECT DISTINCT event_id, coalesce(nullif(regexp_replace(regexp_replace(CASE WHEN length(name) > 0 THEN replace(title, name, '') ELSE title END, '^[\s·:：,，;；—-]+', ''), '[\s·:：,，;；—-]+$', ''), ''), nullif(trim(title), ''), '事件') AS part
FROM (SELECT event_id, title, coalesce(entities[1].name, '') AS name FROM event_record WHERE title IS NOT NULL)""")
def tx12_title_part(s: SparkSession, d: str) -> DataFrame:
    """Titles without the name of their first entity."""
    r = table(s, d, "event_record").where("title IS NOT NULL").select("event_id", "title", F.coalesce(F.get("entities", F.lit(0))["name"], F.lit("")).alias("name"))
    return r.select("event_id", X.title_part(F.col("title"), F.col("name")).alias("part")).distinct()


_PROMOTION = "(?i)" + "|".join(vocab.PROMOTION)


@query(rf"""WITH t AS (SELECT DISTINCT id, regexp_replace(coalesce(description, ''), 'https?://[^\t-\r ]+|www\.[^\t-\r ]+', ' ', 'g') AS x FROM video),
l AS (SELECT id, list_transform(regexp_split_to_array(x, '[\r\n]+'), lambda y: trim(regexp_replace(regexp_replace(y, '#[^\t-\r ]+', ' ', 'g'), '[\t-\r ]+', ' ', 'g'))) AS lines FROM t)
SELECT DISTINCT id, trim(left(array_to_string(list_filter(lines, lambda y: length(y) > 0 AND NOT regexp_matches(y, '{_PROMOTION}')), chr(10)), 4000)) AS clean FROM l""")
def tx13_clean_description(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", X.clean_description("description").alias("clean")).distinct()


def _cut(how, limit: int):
    def f(s: SparkSession, d: str) -> DataFrame:
        return C.cut_texts(table(s, d, "documents"), "doc_id", "text", limit, how).drop("piece")

    return f


_BLANK = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def _cut_sql(limit: int, lists: str, end: str, following: str, trim: bool = True, empty: bool = False, reach: str = "", joined: str = "") -> str:
    """A chunker as a recursion over its cursor: ``lists`` are places of marks, ``end`` the end of the piece from ``p``
    where the window reaches to ``q`` and the text goes on, ``following`` the next cursor; ``reach`` is how far a window
    goes where that is not a number of characters, ``joined`` what else a text needs beside it."""
    lead = f"length(w) - length(regexp_replace(w, '^{_BLANK}+', ''))"
    bare = f"length(regexp_replace(regexp_replace(w, '^{_BLANK}+', ''), '{_BLANK}+$', ''))"
    out = f"SELECT doc_id, p + {lead} AS s, p + {lead} + {bare} AS e FROM w WHERE {bare} > 0" if trim else "SELECT doc_id, p AS s, e FROM w"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, text AS t, CAST(length(text) AS BIGINT) AS n, regexp_split_to_array(text, '') AS ch FROM documents WHERE text IS NOT NULL AND length(text) > 0),
d AS (SELECT doc_id, t, n, {lists} FROM c{joined}),
g AS (SELECT doc_id, 0::BIGINT AS p, 0::BIGINT AS e, 0::BIGINT AS nxt, true AS first FROM d
  UNION ALL SELECT doc_id, p, e, {following}, false FROM (SELECT doc_id, p, CASE WHEN q < n THEN {end} ELSE q END AS e FROM (SELECT d.*, g.nxt AS p, least(d.n, {reach or f"g.nxt + {limit}"}) AS q FROM g JOIN d ON d.doc_id = g.doc_id WHERE g.nxt < d.n))),
w AS (SELECT g.doc_id, g.p, g.e, substr(d.t, g.p + 1, g.e - g.p) AS w FROM g JOIN d ON d.doc_id = g.doc_id WHERE NOT g.first),
o AS ({out}{" UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE text = ''" if empty else ""})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char FROM o"""


def _marks_sql(name: str, test: str) -> str:
    return f"list_filter(range(0, n), lambda i: {test}) AS {name}"


_last = lambda name, low, high="q": f"list_max(list_filter({name}, lambda x: x >= {low} AND x < {high}))"
_BREAKS = _marks_sql("l", "ch[i + 1] = chr(10)")
_CUT_SQL = {
    "tx14_chunks_at_lines": _cut_sql(700, _BREAKS, f"coalesce(nullif(greatest({_last('l', 'p + 350')}, p), p), q)", "greatest(e, p + 1)"),
    "tx15_segments_at_sentences": _cut_sql(350, _marks_sql("l", "ch[i + 1] IN (chr(10), '。', '！', '？', ' ')") + ", " + _marks_sql("k", "ch[i + 1] = '.' AND ch[i + 2] = ' '"), f"coalesce(nullif(greatest({_last('l', 'p + 175')}, {_last('k', 'p + 175', 'q - 1')}, p), p) + 1, q)", "greatest(e, p + 1)"),
    "tx17_packed_lines": _cut_sql(600, "list_filter(range(1, n + 1), lambda i: ch[i] IN (chr(10), chr(11), chr(12), chr(28), chr(29), chr(30), chr(133), chr(8232), chr(8233)) OR (ch[i] = chr(13) AND (i = n OR ch[i + 1] <> chr(10)))) AS l", f"coalesce({_last('l', 'p + 1', 'q + 1')}, q)", "e"),
    # Four times the estimate before rounding, up to each character; a window has at most 1,024.
    "tx21_token_pieces": _cut_sql(256, _marks_sql("l", "ch[i + 1] IN (chr(10), '。')") + ", cost",
        f"coalesce(nullif(greatest({_last('l', 'p + (q - p) // 2')}, p), p) + 1, q)", "e", reach="greatest(g.nxt + 1, g.nxt + len(list_filter(list_slice(d.cost, g.nxt + 1, g.nxt + 1024), lambda x: x <= coalesce(d.cost[g.nxt], 0) + 1024)))",
        joined=" JOIN (SELECT doc_id, list(s ORDER BY i) AS cost FROM (SELECT doc_id, i, sum(CASE WHEN unicode(x) < 128 THEN 1 ELSE 4 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(ch) AS x FROM c)) GROUP BY doc_id) USING (doc_id)"),
    "tx16_pages": _cut_sql(1000, _BREAKS, f"coalesce(nullif(greatest({_last('l', 'p + 700')}, p), p) + 1, nullif(greatest({_last('l', 'p')}, p), p) + 1, q)", "e", False, True),
}


for _name, _how, _limit in (("tx14_chunks_at_lines", C.by_newline, 700), ("tx15_segments_at_sentences", C.by_sentence, 350), ("tx16_pages", C.pages, 1000), ("tx17_packed_lines", C.packed_lines, 600), ("tx21_token_pieces", C.by_tokens, 256)):
    _f = _cut(_how, _limit)
    _f.__name__ = _name
    query(_CUT_SQL.get(_name))(_f)


@query("""SELECT id, kind, sha256(body) AS sha, CAST(length(body) AS INTEGER) AS n FROM (SELECT DISTINCT id, 'title' AS kind, title AS body FROM video WHERE title <> '' UNION SELECT DISTINCT id, 'description', description FROM video WHERE description <> '')""")
def tx18_source_table(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video")
    part = lambda c: v.where(F.col(c) != "").select("id", F.lit(c).alias("kind"), F.col(c).alias("body"))
    rows = part("title").unionByName(part("description")).distinct()
    return rows.select("id", "kind", F.sha2("body", 256).alias("sha"), F.length("body").alias("n"))


@query(r"WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) AS a FROM documents) SELECT doc_id, CAST(n - a + (a + 3) // 4 AS INTEGER) AS tokens FROM t")
def tx19_token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://[^\s）)\]}>，,]+'))) AS INTEGER) AS n FROM documents")
def tx20_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(X.urls("text")).alias("n"))


@query(r"""WITH RECURSIVE o AS (SELECT video_id, doc_id, CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) + (length(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) + 3) // 4 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY video_id ORDER BY doc_id) AS n FROM documents WHERE video_id IS NOT NULL),
b AS (SELECT video_id, doc_id, tokens, n, 0 AS batch, tokens AS used FROM o WHERE n = 1
  UNION ALL SELECT o.video_id, o.doc_id, o.tokens, o.n, CASE WHEN b.used > 0 AND b.used + o.tokens > 800 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used > 0 AND b.used + o.tokens > 800 THEN o.tokens ELSE b.used + o.tokens END FROM b JOIN o ON o.video_id = b.video_id AND o.n = b.n + 1)
SELECT video_id, doc_id, tokens, batch FROM b""")
def tx22_packed_batches(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("video_id IS NOT NULL").select("video_id", "doc_id", X.token_estimate("text").alias("tokens"))
    return C.packed(docs, "video_id", "doc_id", "tokens", 800)


_URLS = r"list_distinct(regexp_extract_all({}, 'https?://[^\s）)\]}}>，,]+'))"


@query(rf"""WITH b AS (SELECT doc_id, coalesce(trim(text), '') AS t, coalesce(text, '') AS raw FROM documents WHERE doc_kind = 'brief'),
c AS (SELECT *, regexp_extract_all(raw, '(?m)^##\s+(.+?)\s*$', 1) AS heads, {_URLS.format('raw')} AS src, {_URLS.format('t')} AS own FROM b)
SELECT doc_id, list_filter([CASE WHEN length(t) < 200 THEN 'too_short' END, CASE WHEN NOT regexp_matches(t, '(?m)^##\s+') THEN 'no_heading' END, CASE WHEN len(src) > 0 AND NOT list_bool_or(list_transform(src, lambda u: contains(t, u))) THEN 'no_source' END,
  CASE WHEN len(src) > 0 AND len(list_filter(own, lambda u: NOT list_contains(src, u))) > 0 THEN 'foreign_source' END], lambda x: x IS NOT NULL)
  || list_transform(list_filter(heads, lambda h: NOT coalesce(list_bool_or(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '^##\s+', '##')) = '##' || h)), false)), lambda h: 'missing_heading:' || h) AS errors FROM c""")
def tx23_brief_errors(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "documents").where("doc_kind = 'brief'")
    return b.select("doc_id", X.brief_errors(F.col("text"), X.required_headings("text"), X.urls("text")).alias("errors"))


@query("SELECT doc_id, replace(replace('# {{date}}' || chr(10) || '{{blocks}}', '{{date}}', coalesce(lang, '')), '{{blocks}}', coalesce(text, '')) AS prompt FROM documents WHERE doc_kind = 'summary'")
def tx24_composed_prompt(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_kind = 'summary'")
    return t.select("doc_id", X.compose(F.lit("# {{date}}\n{{blocks}}"), date=F.coalesce("lang", F.lit("")), blocks=F.coalesce("text", F.lit(""))).alias("prompt"))


@query(r"""SELECT doc_id, trim(array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda y: NOT regexp_full_match(y, '[\t-\r ]*-{3,}[\t-\r ]*') AND NOT regexp_full_match(y, '[\t-\r ]*日期[\t-\r ]*[:：][\t-\r ]*\d{4}[/-]\d{1,2}[/-]\d{1,2}[\t-\r ]*')), chr(10)), chr(32) || chr(9) || chr(10)) AS body FROM documents WHERE doc_kind = 'brief'""")
def tx25_sanitized_markdown(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_kind = 'brief'").select("doc_id", X.sanitize_markdown("text").alias("body"))


_ANSWERS = r"""WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '(?is)<think>.*?</think>', '', 'g')) AS x FROM documents WHERE doc_kind = 'extraction'),
b AS (SELECT doc_id, trim(CASE WHEN regexp_extract(x, '(?is)```(?:json)?[\t-\r ]*(.*?)```', 1) <> '' THEN regexp_extract(x, '(?is)```(?:json)?[\t-\r ]*(.*?)```', 1) ELSE x END) AS x FROM a),
body AS (SELECT doc_id, CASE WHEN regexp_extract(x, '(?s)(\{.*\})', 1) <> '' THEN regexp_extract(x, '(?s)(\{.*\})', 1) ELSE x END AS body FROM b)
"""


@query(_ANSWERS + "SELECT doc_id, body FROM body")
def tx26_stripped_wrappers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_kind = 'extraction'").select("doc_id", X.strip_wrappers("text").alias("body"))


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '\d+(?:[.,]\d+)*[\t-\r ]?%?', '#', 'g') AS masked, len(regexp_extract_all(coalesce(text, ''), '\d+(?:[.,]\d+)*[\t-\r ]?%?')) AS numbers, coalesce(text, '') AS restored FROM documents WHERE doc_kind = 'summary'""")
def tx27_masked_and_restored(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_kind = 'summary'").withColumn("m", X.mask_numbers("text"))
    return t.select("doc_id", F.replace("m.masked", F.lit("\u0001"), F.lit("#")).alias("masked"), F.size("m.numbers").cast("long").alias("numbers"), X.unmask_numbers(F.col("m")).alias("restored"))


@query(r"""WITH u AS (SELECT doc_id, regexp_extract(text, '(https?://[^\s）)\]}>，,]+)', 1) AS url FROM documents WHERE text IS NOT NULL)
SELECT doc_id, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host, CASE WHEN contains(lower(url), 'bilibili.com') THEN 'bilibili' WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' END AS provider FROM u WHERE url <> ''""")
def tx28_source_of_url(s: SparkSession, d: str) -> DataFrame:
    url = F.regexp_extract("text", r"(https?://[^\s）)\]}>，,]+)", 1)
    u = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", url.alias("url")).where("url <> ''")
    return u.select("doc_id", F.nullif(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")).alias("host"), X.provider("url").alias("provider"))


@query("WITH t AS (SELECT DISTINCT id, replace(trim(description, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS x FROM video) SELECT DISTINCT id, CASE WHEN length(x) > 140 THEN rtrim(left(x, 140)) || '…' ELSE x END AS preview FROM t")
def tx29_preview(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", X.preview("description").alias("preview")).distinct()


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def tx30_sha256(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""WITH h AS (SELECT DISTINCT id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('video/' || id)) AS h FROM video WHERE id IS NOT NULL)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS revision_id FROM h""")
def tx31_named_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", X.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("video/"), "id")).alias("revision_id")).distinct()


@query("SELECT DISTINCT id, '/watch?video=' || url_encode(id) || CASE WHEN title IS NOT NULL THEN '&title=' || replace(replace(replace(url_encode(title), '%20', '+'), '~', '%7E'), '%2A', '*') ELSE '' END AS link FROM video")
def tx32_deep_links(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", X.deep_link("/watch", video=F.col("id"), title=F.col("title")).alias("link")).distinct()


@query("SELECT lang, string_split(lower(trim(replace(lang, '_', '-'))), '-')[1] AS code, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def tx33_language_codes(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("lang IS NOT NULL")
    return t.groupBy("lang", X.normalize_language("lang").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT regexp_matches(coalesce(title, ''), '[㐀-鿿]') AS cjk, count(*) AS n FROM video GROUP BY 1")
def tx34_cjk_detection(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").groupBy(X.contains_cjk("title").alias("cjk")).agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(trim(string_split(coalesce(text, ''), chr(10))[1]), '^(?:[#\-*>•][\t-\r ]*)+', '') AS x FROM documents WHERE doc_kind = 'brief'),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_]', '', 'g')) AS x FROM a)
SELECT doc_id, CASE WHEN length(x) <= 20 THEN x ELSE left(x, 19) || '…' END AS snippet FROM b""")
def tx35_snippets(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_kind = 'brief'")
    return t.select("doc_id", X.snippet(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)).alias("snippet"))


@query("SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end FROM orders")
def dt01_period_bounds(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", D.period_start(day, "week").alias("week_start"), D.period_start(day, "month").alias("month_start"), D.period_end(day, "month").alias("month_end"))


@query("SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOURS AS low, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 16 HOURS AS high FROM events")
def dt02_local_day_in_utc(s: SparkSession, d: str) -> DataFrame:
    day = F.col("ts").cast("date")
    low, high = D.period_bounds_utc(day, "day", "Asia/Shanghai")
    return table(s, d, "events").select(day.alias("day"), low.cast("timestamp_ntz").alias("low"), high.cast("timestamp_ntz").alias("high")).distinct()


@query("SELECT event_id, CAST(ts + INTERVAL 8 HOURS AS DATE) AS local_day FROM events")
def dt03_local_date(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", D.local_date(F.col("ts"), "Asia/Shanghai").alias("local_day"))


@query("SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS period_start FROM orders")
def dt04_period_spine(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("z"))
    return o.select(F.explode(D.spine(F.col("a"), F.col("z"), "month")).alias("period_start"))


@query(r"""SELECT DISTINCT id, CASE WHEN regexp_full_match(t, '\d{4}') THEN TRY_CAST(t || '-01-01' AS TIMESTAMP) WHEN regexp_full_match(t, '\d{4}-\d{2}') THEN TRY_CAST(t || '-01' AS TIMESTAMP)
WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}') THEN TRY_CAST(t AS TIMESTAMP) WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?') THEN
  CASE WHEN regexp_matches(t, '(Z|[+-]\d{2}:\d{2})$') THEN TRY_CAST(regexp_replace(regexp_replace(replace(t, ' ', 'T'), '(T\d{2}:\d{2})(Z|[+-])', '\1:00\2'), 'Z$', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
  ELSE TRY_CAST(regexp_replace(replace(t, ' ', 'T'), '(T\d{2}:\d{2})$', '\1:00') AS TIMESTAMP) END END AS at
FROM (SELECT id, trim(time_start) AS t FROM video_time_evidence)""")
def dt05_partial_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video_time_evidence").select("id", D.partial_date(F.col("time_start")).cast("timestamp_ntz").alias("at")).distinct()


@query("SELECT CASE WHEN date_year IS NULL AND time_start IS NULL THEN 'unknown' WHEN precision IN ('second', 'day', 'month', 'year', 'range', 'unknown') THEN precision WHEN date_year IS NULL THEN 'unknown' ELSE 'day' END AS p, count(*) AS n FROM video_time_evidence GROUP BY 1")
def dt06_precision_rules(s: SparkSession, d: str) -> DataFrame:
    p = D.time_precision(F.col("precision"), F.col("date_year"), F.col("time_start"))
    return table(s, d, "video_time_evidence").groupBy(p.alias("p")).agg(F.count("*").alias("n"))


_WIDEN = """SELECT DISTINCT event_id, CAST((CASE time_precision WHEN 'year' THEN CAST(date_trunc('year', a) AS DATE) WHEN 'month' THEN CAST(date_trunc('month', a) AS DATE) ELSE a END) - DATE '1970-01-01' AS INTEGER) AS first_day,
CAST((CASE time_precision WHEN 'year' THEN CAST(date_trunc('year', a) + INTERVAL 1 YEAR AS DATE) - 1 WHEN 'month' THEN last_day(a) ELSE greatest(a, coalesce(b, a)) END) - DATE '1970-01-01' AS INTEGER) AS last_day
FROM (SELECT event_id, time_precision, DATE '1970-01-01' + start_day AS a, DATE '1970-01-01' + end_day AS b FROM event_record WHERE start_day IS NOT NULL)"""


@query(_WIDEN)
def dt07_widened_days(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("start_day IS NOT NULL")
    a, b = D.widened_days(F.date_from_unix_date("start_day"), F.date_from_unix_date("end_day"), F.col("time_precision"))
    return r.select("event_id", a.alias("first_day"), b.alias("last_day")).distinct()


@query("SELECT DISTINCT event_id, CAST(start_day AS BIGINT) * 86400 AS start_s, CAST(greatest(start_day, end_day) + 1 AS BIGINT) * 86400 - 1 AS end_s FROM event_record WHERE start_day IS NOT NULL AND end_day IS NOT NULL")
def dt08_day_bounds(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("start_day IS NOT NULL AND end_day IS NOT NULL")
    return r.select("event_id", (F.col("start_day").cast("long") * 86400).alias("start_s"), ((F.greatest("start_day", "end_day") + 1).cast("long") * 86400 - 1).alias("end_s")).distinct()


@query("SELECT event_id, CAST(to_timestamp(1700000000 + CAST(props->>'$.k' AS BIGINT) * 3600) AS TIMESTAMP) AS at FROM events")
def dt09_published_from_json(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    info = F.to_json(F.struct((k * 3600 + 1_700_000_000).alias("timestamp"), F.lit("20240105").alias("upload_date")))
    return table(s, d, "events").select("event_id", D.published_at(info).cast("timestamp_ntz").alias("at"))


@query("""WITH e AS (SELECT video_id, TRY_CAST(printf('%04d-%02d-%02d', date_year, date_month, date_day) AS DATE) AS day, source, confidence, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, updated_at DESC, id DESC) AS k FROM video_time_evidence
WHERE status = 'accepted' AND confidence >= 0.5 AND date_year BETWEEN 1 AND 9999 AND date_month BETWEEN 1 AND 12 AND date_day BETWEEN 1 AND 31 AND TRY_CAST(printf('%04d-%02d-%02d', date_year, date_month, date_day) AS DATE) IS NOT NULL)
SELECT DISTINCT v.id, coalesce(e.day, CAST(v.published_at AS DATE)) AS day, CASE WHEN e.day IS NOT NULL THEN e.source WHEN v.published_at IS NOT NULL THEN 'platform' END AS time_source FROM video v LEFT JOIN e ON e.video_id = v.id AND e.k = 1""")
def dt10_timeline(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import relational as R

    e = table(s, d, "video_time_evidence").where("status = 'accepted' AND confidence >= 0.5").withColumn("day", D.civil_date("date_year", "date_month", "date_day")).where("day IS NOT NULL")
    e = e.select(F.col("video_id").alias("vid"), "day", "source", "confidence", "updated_at", F.col("id").alias("eid")).withColumnRenamed("vid", "id")
    v = R.with_selected(table(s, d, "video").select("id", "published_at").distinct(), "id", e, [F.desc("confidence"), F.desc("updated_at"), F.desc("eid")], ["day", "source"])
    return v.select("id", F.coalesce("day", F.col("published_at").cast("date")).alias("day"), F.when(F.col("day").isNotNull(), F.col("source")).when(F.col("published_at").isNotNull(), "platform").alias("time_source"))


@query("""SELECT DISTINCT id, CASE WHEN published_at IS NULL OR published_at > TIMESTAMP '2026-03-11 06:00:00' THEN 0 WHEN published_at >= TIMESTAMP '2026-03-10 06:00:00' THEN 20
WHEN published_at >= TIMESTAMP '2026-03-08 16:00:00' AND published_at < TIMESTAMP '2026-03-15 16:00:00' THEN 15 ELSE 0 END AS priority FROM video""")
def dt11_recency_priority(s: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-03-11 06:00:00").cast("timestamp_ntz")
    return table(s, d, "video").select("id", D.recency_priority(F.col("published_at"), now, F.lit(0)).alias("priority")).distinct()


@query("SELECT DISTINCT id, CAST(('0x' || left(sha256(id), 8))::BIGINT % 11 AS BIGINT) AS jitter FROM video")
def dt12_hash_jitter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", D.hash_jitter(F.col("id"), 10).alias("jitter")).distinct()


@query("SELECT o_orderkey, CAST(least(600, 10 * 2 ** (o_orderkey % 9)) AS INTEGER) AS seconds FROM orders")
def dt13_backoff(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", D.backoff_seconds((F.col("o_orderkey") % 9 + 1).cast("int")).alias("seconds"))


@query("""SELECT event_id, (CASE WHEN date_trunc('day', ts + INTERVAL 8 HOURS) + INTERVAL 210 MINUTES <= ts + INTERVAL 8 HOURS THEN date_trunc('day', ts + INTERVAL 8 HOURS) + INTERVAL 1650 MINUTES ELSE date_trunc('day', ts + INTERVAL 8 HOURS) + INTERVAL 210 MINUTES END) - INTERVAL 8 HOURS AS run_at FROM events""")
def dt14_next_daily_run(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", D.next_daily_run(F.col("ts"), 3, 30).cast("timestamp_ntz").alias("run_at"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS shifted, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 3 AS INTEGER) AS months FROM orders")
def dt15_period_shift(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", D.shift_period(day, 2, "month").alias("shifted"), D.period_difference(day, F.lit("1995-03-01").cast("date"), "month").alias("months"))


@query("SELECT count(*) AS n FROM events, (SELECT max(ts) AS t FROM events) WHERE ts BETWEEN t - INTERVAL 24 HOURS AND t")
def dt16_rolling_day(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.where(D.rolling_day(F.col("ts"), e.agg(F.max("ts")).scalar())).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, CAST(CASE WHEN coalesce(duration_sec, 0) <= 0 THEN 600 ELSE greatest(600, ceil(duration_sec / 4.0) + 300) END AS INTEGER) AS timeout FROM video")
def dt17_duration_timeout(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", D.duration_timeout(600, F.col("duration_sec")).alias("timeout")).distinct()


@query("SELECT DISTINCT id, CASE WHEN published_at >= TIMESTAMP '2026-03-08 06:00:00' THEN 10 ELSE 3 END AS priority FROM video")
def dt18_recent_priority(s: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-03-11 06:00:00").cast("timestamp_ntz")
    return table(s, d, "video").select("id", D.recent_priority(F.col("published_at"), now, F.lit(3)).alias("priority")).distinct()


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def ma01_norms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ma02_cosine(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return j.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


@query("SELECT len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AS usable, count(*) AS n FROM event_record WHERE vector IS NOT NULL GROUP BY 1")
def ma03_vector_validation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").where("vector IS NOT NULL").groupBy(V.valid(F.col("vector"), 64).alias("usable")).agg(F.count("*").alias("n"))


@query()
def ma04_reduced_vectors(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.projection import reduce_dimensions

    return reduce_dimensions(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 16)


@query()
def ma05_layout(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.projection import layout

    return layout(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query()
def ma06_topics(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.topics import two_level_topics

    return two_level_topics(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query()
def ma07_anchored_coordinates(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.projection import anchored, layout

    a = table(s, d, "anchor_vector").select(F.col("anchor_rank").cast("long").alias("id"), "vector")
    placed = a.join(layout(a), "id")
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return anchored(e, placed)


@query("SELECT id, CASE WHEN confidence IS NULL OR NOT isfinite(confidence) THEN NULL ELSE greatest(0.0, least(1.0, confidence)) END AS c FROM (SELECT DISTINCT id, confidence FROM video_time_evidence)")
def ma08_clamped_confidence(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "video_time_evidence").select("id", "confidence").distinct()
    return e.select("id", V.clamp_confidence(F.col("confidence").cast("string")).alias("c"))


@query("""WITH b AS (SELECT snapshot_id, min(x)::DOUBLE AS a, max(x)::DOUBLE AS z FROM event_map_canonical GROUP BY 1)
SELECT DISTINCT snapshot_id, canonical_id, CASE WHEN b.z > b.a THEN round((x::DOUBLE - b.a) / (b.z - b.a) * 100, 3) ELSE 50.0 END AS px FROM event_map_canonical JOIN b USING (snapshot_id) WHERE x IS NOT NULL""")
def ma09_rescaled(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical")
    b = c.groupBy("snapshot_id").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    px = F.when(F.col("high") > F.col("low"), F.round((F.col("x").cast("double") - F.col("low")) / (F.col("high") - F.col("low")) * 100, 3)).otherwise(50.0)
    return c.where("x IS NOT NULL").join(b, "snapshot_id").select("snapshot_id", "canonical_id", px.alias("px")).distinct()


@query("SELECT DISTINCT id, list_sort(list_distinct(tags)) AS tags, list_slice(tags, 1, 2) AS first_two FROM video WHERE tags IS NOT NULL")
def ar01_sorted_distinct(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").where("tags IS NOT NULL")
    return v.select("id", F.array_sort(F.array_distinct("tags")).alias("tags"), F.slice("tags", 1, 2).alias("first_two")).distinct()


@query("SELECT DISTINCT event_id, e.entity_type, e.name FROM (SELECT event_id, unnest(entities) AS e FROM event_record) UNION SELECT DISTINCT event_id, 'relation', r.relation_type FROM (SELECT event_id, unnest(relations) AS r FROM event_record)")
def ar02_flattened(s: SparkSession, d: str) -> DataFrame:
    both = F.concat(F.coalesce(F.transform("entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), e["name"].alias("name"))), F.array()), F.coalesce(F.transform("relations", lambda r: F.struct(F.lit("relation").alias("entity_type"), r["relation_type"].alias("name"))), F.array()))
    return table(s, d, "event_record").select("event_id", F.inline(both)).distinct()


@query("SELECT DISTINCT event_id, list_filter(evidence, lambda e: e.evidence_text IS NOT NULL)[1].evidence_text AS quoted FROM event_record")
def ar03_first_nested(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").select("event_id", F.get(F.filter("evidence", lambda e: e["evidence_text"].isNotNull()), F.lit(0))["evidence_text"].alias("quoted")).distinct()


@query("""WITH e AS (SELECT DISTINCT event_id, unnest(evidence) AS e FROM event_record), t AS (SELECT video_id, max(created_at) AS at FROM asset WHERE type = 'transcript' GROUP BY 1), s AS (SELECT event_id, CASE WHEN e.e.video_id IS NULL THEN 'unknown' WHEN t.at IS NULL THEN 'unavailable' WHEN t.at > TIMESTAMP '2025-09-01' THEN 'superseded' ELSE 'current' END AS st FROM e LEFT JOIN t ON t.video_id = e.e.video_id)
SELECT event_id, CASE WHEN bool_or(st = 'superseded') THEN 'superseded' WHEN bool_or(st = 'unavailable') THEN 'unavailable' WHEN bool_or(st = 'unknown') THEN 'unknown' ELSE 'current' END AS version_status FROM s GROUP BY 1""")
def ar04_version_status(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_record").select("event_id", F.explode("evidence").alias("e")).select("event_id", "e.video_id").distinct()
    t = table(s, d, "asset").where("type = 'transcript'").groupBy("video_id").agg(F.max("created_at").alias("at"))
    st = F.when(F.col("video_id").isNull(), "unknown").when(F.col("at").isNull(), "unavailable").when(F.col("at") > F.lit("2025-09-01").cast("timestamp_ntz"), "superseded").otherwise("current")
    worst = X.lookup({"superseded": 3, "unavailable": 2, "unknown": 1, "current": 0}, st)
    top = e.join(t, "video_id", "left").groupBy("event_id").agg(F.max(worst).alias("w"))
    return top.select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("current", "unknown", "unavailable", "superseded")]), F.col("w") + 1).alias("version_status"))


@query("SELECT DISTINCT id, trim(regexp_replace(lower(trim(coalesce(name, ''))), '[^0-9a-z]+', '_', 'g'), '_') AS k, length(coalesce(name, '')) - length(regexp_replace(coalesce(name, ''), '[^\\x00-\\x7F]', '', 'g')) + (length(regexp_replace(coalesce(name, ''), '[^\\x00-\\x7F]', '', 'g')) + 3) // 4 AS tokens FROM media")
def ud01_registered_functions(s: SparkSession, d: str) -> DataFrame:
    """Functions of this package called by name from SQL."""
    from tidemark.plans.catalog import register_functions

    register_functions(s)
    table(s, d, "media").createOrReplaceTempView("ud01_media")
    return s.sql("SELECT DISTINCT id, snake_key(name) AS k, CAST(token_estimate(name) AS BIGINT) AS tokens FROM ud01_media")


@query("SELECT DISTINCT prompt_version, sha256(concat_ws('|', model, prompt_version, prompt_text, chunk_max_chars, overlap_chars)) AS version FROM extraction_spec")
def ud02_spec_versions(s: SparkSession, d: str) -> DataFrame:
    """The identity of a user's extraction spec, as it enters build and cache keys."""
    e = table(s, d, "extraction_spec")
    return e.select("prompt_version", F.sha2(F.concat_ws("|", "model", "prompt_version", "prompt_text", F.col("chunk_max_chars").cast("string"), F.col("overlap_chars").cast("string")), 256).alias("version")).distinct()


@query("SELECT DISTINCT id, replace(replace(CASE provider WHEN 'castnet' THEN '# {{name}} ({{zone}})' ELSE '## {{name}}' END, '{{name}}', coalesce(name, '')), '{{zone}}', coalesce(time_zone, 'UTC')) AS brief FROM media")
def ud03_domain_templates(s: SparkSession, d: str) -> DataFrame:
    """A template of its own for each source."""
    m = table(s, d, "media").withColumn("template", F.when(F.col("provider") == "castnet", "# {{name}} ({{zone}})").otherwise("## {{name}}"))
    return m.select("id", X.compose(F.col("template"), name=F.coalesce("name", F.lit("")), zone=F.coalesce("time_zone", F.lit("UTC"))).alias("brief")).distinct()


_PARSED = _ANSWERS.rstrip() + """,
env AS (SELECT doc_id, CASE WHEN json_valid(body) AND json_type(body, '$.videos') = 'ARRAY' THEN json_extract(body, '$.videos') END AS videos FROM body),
vid AS (SELECT doc_id, json_extract(videos, '$[' || i || ']') AS v FROM (SELECT doc_id, videos, unnest(range(0, json_array_length(videos)::BIGINT)) AS i FROM env WHERE videos IS NOT NULL)),
ids AS (SELECT doc_id, v->>'$.video_id' AS video_id, json_extract(v, '$.events') AS events FROM vid),
ev AS (SELECT doc_id, video_id, i AS event_no, json_extract(events, '$[' || i || ']') AS e FROM (SELECT doc_id, video_id, events, unnest(range(0, json_array_length(events)::BIGINT)) AS i FROM ids WHERE video_id IS NOT NULL AND json_type(events) = 'ARRAY'))
"""


@query(_PARSED + r"""SELECT doc_id AS answer_id, video_id, CAST(event_no AS INTEGER) AS event_no, left(regexp_replace(regexp_replace(e->>'$.title', '[\t-\r\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), 300) AS title,
coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(e->>'$.event_type', ''))), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'other') AS event_type, CASE WHEN isfinite(TRY_CAST(e->>'$.confidence' AS DOUBLE)) THEN greatest(0.0, least(1.0, TRY_CAST(e->>'$.confidence' AS DOUBLE))) END AS confidence
FROM ev WHERE length(trim(coalesce(e->>'$.title', ''))) > 0""")
def js01_parsed_answers(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_kind = 'extraction'")
    events, _ = J.parse_answers(t, "doc_id", "text", F.array().cast("array<string>"))
    return events.select("answer_id", "video_id", "event_no", "title", "event_type", "confidence")


@query(_PARSED + """SELECT doc_id AS answer_id, 'no_envelope' AS problem, 'error' AS level FROM env WHERE videos IS NULL
UNION ALL SELECT doc_id, 'missing:v1', 'error' FROM env WHERE doc_id NOT IN (SELECT doc_id FROM ids WHERE video_id = 'v1')
UNION ALL SELECT DISTINCT doc_id, 'unknown:' || coalesce(video_id, ''), 'error' FROM ids WHERE video_id IS DISTINCT FROM 'v1'
UNION ALL SELECT doc_id, 'repeated_id', 'error' FROM (SELECT doc_id, count(*) AS n, count(DISTINCT coalesce(video_id, chr(1))) AS k FROM ids GROUP BY 1) WHERE n > k
UNION ALL SELECT doc_id, 'no_title:' || video_id || '/' || event_no, 'warning' FROM ev WHERE video_id = 'v1' AND length(trim(coalesce(e->>'$.title', ''))) = 0""")
def js01_answer_problems(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_kind = 'extraction'")
    return J.parse_answers(t, "doc_id", "text", F.array(F.lit("v1")))[1]


@query("""WITH r AS (SELECT event_id, entities, unnest(relations) AS r FROM event_record WHERE entities IS NOT NULL AND relations IS NOT NULL), w AS (SELECT event_id, r.source_entity_key AS k, len(list_filter(entities, lambda e: e.key = r.source_entity_key)) AS n FROM r)
SELECT DISTINCT event_id, CASE WHEN k IS NULL OR k = '' THEN 'missing:source_entity_key' WHEN n = 0 THEN 'unmatched:source_entity_key:' || k ELSE 'ambiguous:source_entity_key:' || k END AS warning FROM w WHERE k IS NULL OR k = '' OR n <> 1""")
def js02_endpoint_warnings(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("entities IS NOT NULL AND relations IS NOT NULL")
    w = r.select("event_id", F.explode(J.endpoint_warnings(F.col("entities"), F.col("relations"))).alias("warning"))
    return w.where(F.col("warning").contains("source_entity_key")).distinct()


@query("SELECT DISTINCT r.event_id, e.evidence_id, v.id IS NOT NULL AS known FROM (SELECT event_id, unnest(list_slice(evidence, 1, 12)) AS e FROM event_record) r LEFT JOIN (SELECT DISTINCT id FROM video) v ON v.id = e.video_id")
def js03_provenance(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").select("event_id", F.explode(F.slice("evidence", 1, 12)).alias("e")).select("event_id", "e.evidence_id", F.col("e.video_id").alias("id"))
    v = table(s, d, "video").select("id", F.lit(True).alias("k")).distinct()
    return r.join(v, "id", "left").select("event_id", "evidence_id", F.col("k").isNotNull().alias("known")).distinct()


@query(r"""SELECT DISTINCT event_id, left(sha256(trim(regexp_replace(lower(left(regexp_replace(regexp_replace(coalesce(title, ''), '[\t-\r\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), 160)), '[^0-9a-z一-鿿._:-]+', '_', 'g'), '_') || '|' || coalesce(event_type, 'other') || '|' || coalesce(CAST(start_day AS VARCHAR), '')), 24) AS event_key FROM event_record""")
def js04_event_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").select("event_id", J.event_key(F.col("title"), F.col("event_type"), F.col("start_day")).alias("event_key")).distinct()


@query("""SELECT DISTINCT event_id, concat_ws(chr(10), CASE WHEN length(title) > 0 THEN 'title: ' || title END, CASE WHEN length(summary) > 0 THEN 'summary: ' || summary END, CASE WHEN length(event_type) > 0 THEN 'type: ' || event_type END,
CASE WHEN length(n) > 0 THEN 'entities: ' || n END) AS body FROM (SELECT event_id, title, summary, event_type, array_to_string(list_sort(list_distinct(list_transform(coalesce(entities, []), lambda e: e.name))), ', ') AS n FROM event_record)""")
def js05_embedding_text(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").dropDuplicates(["event_id"])
    return r.select("event_id", J.embedding_text(F.col("title"), F.col("summary"), F.col("event_type"), F.coalesce(F.col("entities.name"), F.array().cast("array<string>"))).alias("body"))


@query(r"""SELECT doc_id, CAST(len(l) AS INTEGER) AS points, len(list_filter(l, lambda x: length(x) > 400)) = 0 AS within, len(list_filter(l, lambda x: regexp_matches(x, '\[\d+\]$'))) > 0 AS cited
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '- ')) AS l FROM documents WHERE doc_kind = 'brief')""")
def js06_brief_bounds(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "documents").where("doc_kind = 'brief'")
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("- "))
    return b.select("doc_id", F.size(lines).alias("points"), F.forall(lines, lambda x: F.length(x) <= 400).alias("within"), F.exists(lines, lambda x: x.rlike(r"\[\d+\]\z")).alias("cited"))


@query("SELECT event_id, CAST(json_object('value', value) AS VARCHAR) AS wrapped FROM events")
def js07_scalar_as_object(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.to_json(F.struct("value")).alias("wrapped"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def js08_merged_usage(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    day = table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.struct(F.count("*").alias("calls"), F.sum(k).alias("input"), F.lit(0).alias("output"), F.lit(None).cast("long").alias("total")).alias("u"))
    # One usage a day: the list of a user is bounded by the days of the log.
    return day.groupBy("user_id").agg(J.merge_usage(F.collect_list("u")).alias("m")).select("user_id", "m.calls", "m.total")
