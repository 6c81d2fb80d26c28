import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm import mixing as M
from tidemark.llm import stuffing as S
from tidemark.llm import tokens as T
from tidemark.session import Stages


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return t


def ids(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_equal_the_public_library(encoder, public, texts):
    assert ids(encoder, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_odd_texts(encoder, public):
    texts = [None, "", " ", "\n\n \t x", "aaaaaaaaaaaaa", "<|endoftext|>", "naïve 漢字 🙂🙂 ไทย", "x" * 50_000, "word " * 20_000, "'s 'll don't"]
    assert ids(encoder, texts) == [public.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert encoder.count(texts).tolist() == [len(i) for i in ids(encoder, texts)]


def test_encode_keeps_rows_and_columns(spark, rows):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "hi there", "n"), (3, "hi there", "n")], "doc_id long, text string, ids string")
    got = rows(T.encode(df, ids="tokens"), "doc_id", "ids", "tokens")
    assert got == [(1, "n", []), (2, "n", []), (3, "n", [5303, 612]), (3, "n", [5303, 612])]
    assert T.encode(df.limit(0), ids="tokens").count() == 0


def greedy(text, limit, overlap):
    n, at, kind = C.boundaries(text)
    of, p, out = dict(zip(at.tolist(), kind.tolist())), 0, []
    while p < n:
        start = p - overlap if p else 0
        reach = start + limit
        if reach >= n:
            return [*out, n]
        for low, least in ((start + limit // 2, C.LINE), (start + limit // 2, C.SENTENCE), (p, C.WORD)):
            fit = [b for b in of if max(low, p) < b <= reach and of[b] >= least]
            if fit:
                break
        p = max(fit) if fit else reach
        out.append(p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_a_greedy_walk(seed):
    rng = random.Random(seed)
    for _ in range(150):
        t = "".join(rng.choice("abc" * rng.randint(1, 4) + " .\n。　") for _ in range(rng.randint(1, 160))) + "x" * rng.choice([0, 0, 70]) + " end"
        limit = rng.randint(5, 40)
        overlap = rng.randint(0, (limit - 1) // 2)
        n, at, kind = C.boundaries(t)
        if n > limit:
            ends, kinds = C.cut(n, at, kind, limit, overlap)
            starts = [0, *(e - overlap for e in ends[:-1])]
            assert ends.tolist() == greedy(t, limit, overlap) and all(e - s <= limit for s, e in zip(starts, ends))
            assert all(k != 0 or C.longest_run(n, at) > limit - overlap - 1 for k in kinds)
            assert bool((C.runs_cut(n, at, ends, kinds) > limit).any()) == (C.longest_run(n, at) > limit)
        assert C.longest_run(n, at) == max(len(x) for x in re.split(r"[\s.!?。！？]", t))


def test_pieces(spark):
    long, run = "Some words here. " * 20, "y" * 120
    df = spark.createDataFrame([("a", long, 1), ("b", run, 1), ("c", "short", 1), ("d", None, 1), ("e", "", 1)], "id string, body string, forced int")
    got = {r["id"]: r for r in C.pieces(df, "id", "body", [C.Spec("s", 100, 10)], True).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["forced"], got["b"]["forced"]) == (0, 1)
    for k, text in (("a", long), ("b", run)):
        p = got[k]["pieces"]
        assert p[0]["start"] == 0 and p[-1]["end"] == len(text) and all(x["text"] == text[x["start"] : x["end"]] for x in p)
        assert all(b["start"] == a["end"] - 10 for a, b in zip(p, p[1:]))
    with pytest.raises(ValueError):
        C.Spec("s", 100, 50)
    assert C.pieces(df.limit(0), "id", "body", [C.Spec("s", 100, 10)]).count() == 0


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    size, pi = rng.integers(1, 3000, 500), np.full(500, 0.3)
    out = M.flight(pi, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3
    same = M.flight(pi, np.full(500, 7), rng)
    assert ((same > 1e-9) & (same < 1 - 1e-9)).sum() <= 2 and abs(same.sum() - 150) < 1e-6


def test_landing_without_exchange_keeps_the_flight():
    pi, size = np.array([1.0, 0.0, 0.4, 1.0]), np.array([5, 9, 3, 4])
    first = np.full(4, 0.6)
    assert M.land(pi, size, first, False).tolist() == [1.0, 0.0, 0.0, 1.0]
    assert abs((M.land(pi, size, first) * size).sum() - (first * size).sum()) <= abs((M.land(pi, size, first, False) * size).sum() - (first * size).sum())


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    rng = random.Random(2)
    docs = [(i, s, " ".join("word" for _ in range(rng.randint(1, 60))), "x") for i, s in enumerate(["big"] * 400 + ["mid"] * 90 + ["small"] * 12 + ["unnamed"] * 30 + [None] * 5)]
    docs += [(900, "big", None, "x"), (901, "big", "", "x"), (None, "big", "word word", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("nothing", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = M.mix(spark, df, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"big", "mid", "small", "nothing"} and got["nothing"]["actual_share"] == 0.0
    assert all(abs(got[s]["actual_share"] - w) < 0.01 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    assert all(1 <= r["copies"] <= {"big": 1, "mid": 2, "small": 4}[r["source"]] for r in drawn.collect())
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert M.mix(spark, df.limit(0), targets)[0].count() == 0


def test_small_sources_land_with_all_their_documents_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    rng = random.Random(6)
    names = [f"s{i}" for i in range(8)]
    docs = [(i, s, " ".join("word" for _ in range(rng.randint(1, 60)))) for i, s in enumerate(["big"] * 400 + [n for n in names for _ in range(30)])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = [("big", 0.6, 1), *((n, 0.05, 1) for n in names)]
    drawn, _ = M.mix(spark, df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), 2500)
    got = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
    assert all(abs(got[n] - 125) <= 1 for n in names) and abs(got["big"] - 1500) <= 15, got


REAL = "The board of the company said that it will publish the numbers for the third quarter in the coming week. "
MARKED = {"tags": "#Steel #SteelToday #Copper99 " * 12, "links": "https://a-news.example/p/1\n" * 12, "handles": "@mara12 #Copper " * 15, "prices": "steel Ref 41856 $656 / steel SKU 5512 €40 / " * 9}
NOUNS = "board company market report plant bank supply demand port harbour price week quarter number analyst house".split()
VERBS = "said published closed opened moved raised cut sold bought reported".split()
PLACES = [a + b for a in "mor tal vel sen kar".split() for b in "din ga nor lix".split()]
KEYWORDS, OFFERS = "copper steel palladium freight wafer jetfuel".split(), "cheap buy login broker free online discount".split()
PLAIN = {
    "ru": "Совет директоров сообщил, что опубликует данные за третий квартал на следующей неделе. Завод в городе закрыли ещё весной, и никто не объяснил причину.",
    "pl": "Zarząd spółki poinformował, że opublikuje wyniki za trzeci kwartał w przyszłym tygodniu. Fabryka w mieście stoi od wiosny i nikt nie podał powodu.",
    "ko": "이사회는 다음 주에 삼분기 실적을 발표할 것이라고 밝혔다. 그 도시의 공장은 봄부터 멈춰 있으며 아무도 이유를 설명하지 않았다.",
    "ja": "取締役会は来週に第三四半期の業績を発表すると述べた。その町の工場は春から止まっており、誰も理由を説明していない。",
}


def speech(rng, n):
    noun, verb, place = (lambda: rng.choice(NOUNS)), (lambda: rng.choice(VERBS)), (lambda: rng.choice(PLACES).title())
    one = lambda: rng.choice([f"The {noun()} of {place()} {verb()} the {noun()} of {rng.choice(KEYWORDS)} in the last {noun()}.", f"After the {noun()} was {verb()} by {place()}, the {noun()} in {place()} will not be {verb()} again.", f"Nobody at the {noun()} {verb()} why the {noun()} of {rng.choice(KEYWORDS)} is still so low."])
    return " ".join(one() for _ in range(n))


def salad(rng, n):
    return " ".join(rng.choice(KEYWORDS if rng.random() < 0.5 else OFFERS) for _ in range(n))


@pytest.fixture(scope="module")
def crawl():
    rng = random.Random(3)
    good = [speech(rng, rng.randint(4, 14)) for _ in range(500)]
    lots = ["".join(f"Lot {i} of copper from {p} was sold by the bank of {rng.choice(PLACES)} at {i * 7} per tonne. " for i in range(20)) for p in PLACES]
    bad = [salad(rng, rng.randint(40, 120)) for _ in range(60)]
    for k in KEYWORDS:
        bad += ["\n".join(f"{k} {offer} {p}" for p in rng.sample(PLACES, 15)) for offer in OFFERS[:4]]
    bad += [speech(rng, 2) + "\n" + salad(rng, 150) for _ in range(10)]
    good += [speech(rng, 12) + "\n" + salad(rng, 30) for _ in range(10)]
    return good + lots, bad


def test_marked_share():
    none = np.zeros(0, np.uint64), np.zeros(0), 0.25
    for text in MARKED.values():
        share = lambda t: float(S.Slice([t]).stuffed(*none)[0])
        assert share(text) > 0.5 or "Ref" in text
        assert share(text + "\n" + REAL * (3 * len(text) // len(REAL))) < 0.5
    assert S.Slice([MARKED["prices"]]).linked[0] > 0.4


def test_pages(spark, crawl):
    """Stuffed pages of any template come out, plain pages of languages that the corpus does not know do not."""
    good, bad = crawl
    docs = [(i, t, None) for i, t in enumerate(good)] + [(10_000 + i, t, None) for i, t in enumerate(bad + list(MARKED.values())[:3])]
    docs += [(20_000 + i, t, None) for i, t in enumerate(PLAIN.values())] + [(30_000, None, None), (30_001, "", None), (30_002, " \n\t", None), (None, MARKED["tags"], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, stuffed string")
    got = {r["doc_id"] for r in S.stuffed_pages(spark, df).collect()}
    want = {d[0] for d in docs if d[0] and 10_000 <= d[0] < 20_000}
    assert not got - want and len(want - got) <= len(want) // 50, (got - want, want - got)
    assert S.stuffed_pages(spark, df.limit(0)).count() == 0


def test_plain_pages_of_many_languages_beside_known_ones(spark, crawl):
    """A language that makes half of the corpus is no stuffing either."""
    good, bad = crawl
    rng = random.Random(5)
    ru = [s.strip() for t in (PLAIN["ru"], "Банк снизил ставку. Цены на медь выросли после забастовки. Порт открыли вчера, но груз пока не пришёл.") for s in t.split(".") if s.strip()]
    pages = [". ".join(rng.choice(ru) for _ in range(6)) + "." for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(good[:300] + bad)] + [(50_000 + i, t) for i, t in enumerate(pages)]
    got = {r["doc_id"] for r in S.stuffed_pages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got and max(got) < 50_000 and min(got) >= 300


def test_coherence_is_that_of_a_plain_count(spark):
    """The mean of log ratios of a pair and its reverse on other pages, and the share of excessive pairs."""
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(20, 60))) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("fit", F.lit(True))
    seen = df.mapInArrow(S._scan, S.SCHEMA).persist()
    kind = lambda k: seen.where(F.col("kind") == k)
    pairs = kind(S.PAIR_ROW).groupBy("key").agg(F.sum("n").alias("all_n"))
    got = {r["doc_id"]: r for r in S.page_coherence(kind(S.OWN_PAIR).select("doc_id", "key", "back", "n", "n_back"), pairs, kind(S.PAGE_ROW).select("doc_id", "size", "linked")).collect()}
    from collections import Counter

    own = {i: Counter(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    every = sum(own.values(), Counter())
    for i, c in own.items():
        gaps, told = 0.0, 0
        for (a, b), n in c.items():
            ahead, behind = every[a, b] - n, every[b, a] - c[b, a]
            if a != b and ahead + behind >= S.EVIDENCE:
                gaps, told = gaps + n * np.log((ahead + 0.5) / (behind + 0.5)), told + n
        if 2 * told >= sum(c.values()):
            assert abs(got[i]["coherence"] - gaps / told) < 1e-9
        much = sum(n for (a, b), n in c.items() if n >= 2 and n > S.EXCESS * sum(c.values()) * (every[a, b] - n + 0.5) / sum(every.values()))
        assert abs(got[i]["excess"] - much / sum(c.values())) < 1e-9


def test_long_texts_and_far_characters():
    long = REAL * (S.SLICE // len(REAL) + 200)
    both = S.Slice([long, MARKED["links"]])
    assert both.linked[0] == 0.0 < 0.9 < both.linked[1]
    assert S.Slice([long]).word.tolist() == both.word[both.doc == 0].tolist()
    # Letters above U+FFFF are words: two signs of an extension block, and one run of Gothic letters.
    far = S.Slice(["\U00020000\U00020001 \U00010330\U00010331"])
    assert far.kind.tolist() == [S.CJK, S.CJK, S.LETTER] and len(set(far.word.tolist())) == 3


def test_a_short_title_is_no_page(spark):
    df = spark.createDataFrame([(1, "Velgra Steel output"), (2, "#Steel #Copper")], "doc_id long, text string")
    assert [r["doc_id"] for r in S.stuffed_pages(spark, df).collect()] == [2]


def test_every_page_takes_part_in_the_fit(spark):
    """Seeds are found and words get their odds from all pages: here the stuffed ones are 24 of 20,000, so a sample of
    half the pages is another fit. Each template's words stand in four pages of salad and one that only they betray."""
    rng = random.Random(11)
    noun, verb, place = (lambda: rng.choice(NOUNS)), (lambda: rng.choice(VERBS)), (lambda: rng.choice(PLACES).title())
    docs = [(i, f"The {noun()} of {place()} {verb()} the {noun()} in the last {noun()}. Nobody at the {noun()} {verb()} why.") for i in range(20_000)]
    want = set()
    for k in range(6):
        words = [f"{a}{b}" for a in (f"zu{chr(97 + k)}", f"qe{chr(97 + k)}") for b in "bo ki ra nu".split()]
        for j in range(4):
            want.add(30_000 + 10 * k + j)
            docs.append((30_000 + 10 * k + j, " ".join(rng.choice(words) for _ in range(60))))
        want.add(30_000 + 10 * k + 9)
        docs.append((30_000 + 10 * k + 9, " ".join(rng.sample(words, 5))))
    rng.shuffle(docs)
    assert {r["doc_id"] for r in S.stuffed_pages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_figures_of_blocks_are_those_of_plain_joins(spark, crawl):
    """Pairs added up over blocks of any size give every page the figures that a join of all its pairs gives it."""
    good, bad = crawl
    texts = [*good[:120], *bad[:60], "a a a a b a", "7 8 9", "#Steel #Copper", "\n", *PLAIN.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen = df.withColumn("fit", F.lit(True)).mapInArrow(S._scan, S.SCHEMA).persist()
    kind = lambda k: seen.where(F.col("kind") == k)
    pairs = kind(S.PAIR_ROW).groupBy("key").agg(F.sum("n").alias("all_n"))
    plain = {r["doc_id"]: r for r in S.page_coherence(kind(S.OWN_PAIR).select("doc_id", "key", "back", "n", "n_back"), pairs, kind(S.PAGE_ROW).select("doc_id", "size", "linked")).collect()}
    for most in (1, 3_000, S.BLOCK):
        blocks = S.page_blocks(Stages(spark, "test"), df, most)
        assert blocks.count() == len(texts) or most > 1
        got = {r["doc_id"]: r for r in S.page_figures(blocks).collect()}
        assert set(got) == set(range(len(texts))) and {i for i, r in got.items() if r["size"]} == set(plain)
        for i, r in plain.items():
            assert got[i]["size"] == r["size"] and got[i]["linked"] == r["linked"] and abs(got[i]["excess"] - r["excess"]) < 1e-9
            assert (got[i]["coherence"] is None) == (r["coherence"] is None) and abs((got[i]["coherence"] or 0) - (r["coherence"] or 0)) < 1e-9


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(0, 3, 5_001), np.array([-0.5, 1e300, -1e-300, 0.0, 2.0, 2.0, 2.0]), np.array([1.5])):
        df = spark.createDataFrame([(float(v), int(r)) for v, r in zip(x, S._ranked(x))], "x double, rank long")
        assert S.quantiles(df, [0.25, 0.75, 1.0]) == pytest.approx([float(v) for v in np.quantile(x, [0.25, 0.75, 1.0])], rel=1e-12)
    assert S.quantiles(df.limit(0), [0.5]) == [0.0]


def test_a_block_survives_packing():
    """Narrow places and sizes, negative ids, pages without words, and numbers, which make no pairs."""
    texts = [REAL, "1 2 3", "#Steel", "b a b a a " * 50]
    block = S.Block.of([S.Block.part(np.array([-5, 2**40, 7, 8]), S.Slice(texts))])
    back = S.Block.unpacked(*block.packed())
    assert all(a.tolist() == b.tolist() for a, b in zip(block, back))
    assert back.stuffed(np.zeros(0, np.uint64), np.zeros(0), 0.25).tolist() == S.Slice(texts).stuffed(np.zeros(0, np.uint64), np.zeros(0), 0.25).tolist()
    p = back.pairs()
    assert 1 not in p.doc and int(p.ahead.sum() + p.behind.sum()) == int(back.beside().sum()) == len(p.at)
