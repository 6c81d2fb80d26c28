import uuid

import numpy as np
import pytest

from tidemark.operators import canonical as K
from tidemark.operators import stories as S
from tidemark.operators.groups import diverse_cards
from tidemark.operators.matching import greedy_matching, labelled_components
from tidemark.session import Stages

ENTITY = "array<struct<entity_type:string,key:string,name:string,role:string,confidence:double>>"
RELATION = "array<struct<relation_type:string,confidence:double,evidence_text:string,source_claim:string,target_claim:string,source_entity_key:string,target_entity_key:string>>"
EVIDENCE = "array<struct<evidence_id:string,video_id:string,evidence_text:string,confidence:double>>"
RECORD = f"domain string, event_id string, revision_id string, title string, summary string, event_type string, direction string, start_day int, end_day int, time_precision string, source_video_id string, entities {ENTITY}, relations {RELATION}, evidence {EVIDENCE}, vector array<float>, note string"


def uid(n):
    return str(uuid.UUID(int=n))


def record(n, title="Rates held", day=10, end=None, kind="policy", precision="day", direction="neutral", entity=("institution", "fed", "Fed"), vector=(1.0, 0.0), summary="", video=None, proof="said so", relations=None, role="actor"):
    evidence = [(uid(900 + n), uid(500 + (video or n)), proof, 0.9)] if proof else []
    return ("d", uid(n), uid(1000 + n), title, summary, kind, direction, day, day if end is None else end, precision, uid(500 + (video or n)), [(entity[0], entity[1], entity[2], role, 0.9)], relations or [], evidence, [float(x) for x in vector], None)


def neighbours(spark, pairs):
    return spark.createDataFrame([("d", uid(a), uid(b), s) for a, b, s in pairs], "domain string, left string, right string, similarity double")


def run(spark, records, pairs=()):
    st = Stages(spark, "test")
    members, groups = K.canonicalize(st, spark.createDataFrame(records, RECORD), neighbours(spark, pairs))
    return {r["event_id"]: r for r in members.collect()}, {r["group_id"]: r for r in groups.collect()}


def both(*pairs):
    return [p for a, b, s in pairs for p in ((a, b, s), (b, a, s))]


def test_exact_groups_and_singletons(spark):
    m, g = run(spark, [record(1), record(2), record(3, title="Rates kept", day=11)])
    assert sorted(x["size"] for x in g.values()) == [1, 2] and m[uid(1)]["rule"] == "exact" and m[uid(3)]["rule"] == "singleton"
    assert m[uid(1)]["group_id"] == m[uid(2)]["group_id"]


def test_a_clear_pair_merges(spark):
    m, g = run(spark, [record(1), record(2, title="Fed holds", vector=(1.0, 0.1))], both((1, 2, 0.95)))
    assert len(g) == 1 and m[uid(1)]["rule"] == "fuzzy" and m[uid(1)]["score"] == 0.95


def test_two_near_equal_candidates_are_ambiguous(spark):
    _, g = run(spark, [record(1), record(2, title="b"), record(3, title="c")], both((1, 2, 0.95), (1, 3, 0.93)))
    assert len(g) == 3 and "ambiguous_fuzzy_candidates" in g[uid(1)]["flags"]


def test_a_neighbour_listed_twice_is_its_own_runner_up(spark):
    _, g = run(spark, [record(1), record(2, title="b")], both((1, 2, 0.95)) * 2)
    assert len(g) == 2 and all(x["flags"] == ["ambiguous_fuzzy_candidates"] for x in g.values())


@pytest.mark.parametrize("other", [
    {"precision": "year"}, {"title": "cut 50bp", "of": "cut 25bp"}, {"day": 30}, {"kind": "earnings"}, {"entity": ("company", "x", "X")}, {"direction": "up", "from": "down"}, {"vector": (0.0, 1.0)}, {"sim": 0.8}, {"role": "source"},
])
def test_what_keeps_a_pair_apart(spark, other):
    first = {"title": other.pop("of", "a"), "direction": other.pop("from", "neutral")}
    sim = other.pop("sim", 0.95)
    _, g = run(spark, [record(1, **first), record(2, **{"title": "b"} | other)], both((1, 2, sim)))
    assert len(g) == 2


def test_compatible_types_and_month_threshold(spark):
    assert len(run(spark, [record(1), record(2, title="b", kind="monetary_policy")], both((1, 2, 0.86)))[1]) == 1
    assert len(run(spark, [record(1, precision="month"), record(2, title="b")], both((1, 2, 0.86)))[1]) == 2


def test_a_group_merges_once(spark):
    rs = [record(1), record(2), record(3, title="b"), record(4, title="c")]
    m, g = run(spark, rs, both((1, 3, 0.99), (2, 4, 0.95)))
    assert len(g) == 2 and m[uid(3)]["group_id"] == uid(1) and m[uid(4)]["group_id"] == uid(4)
    assert "ambiguous_fuzzy_candidates" in g[uid(4)]["flags"] and "ambiguous_fuzzy_candidates" in g[uid(1)]["flags"]


def test_empty_records(spark):
    assert run(spark, []) == ({}, {})


def members(spark, groups):
    return spark.createDataFrame([("d", uid(e), uid(g)) for g, events in groups.items() for e in events], "domain string, event_id string, group_id string")


@pytest.mark.parametrize(("previous", "groups", "states", "kinds"), [
    ({70: [1, 2]}, {1: [1, 2]}, ["retained"], []), ({70: [1, 2, 3, 4]}, {1: [1, 2], 3: [3, 4]}, ["new", "new"], ["split", "split"]),
    ({70: [1, 2], 71: [3, 4]}, {1: [1, 2, 3, 4]}, ["new"], ["merge", "merge"]), ({70: [1]}, {1: [1, 2, 3]}, ["new"], ["replaced"]), ({}, {1: [1]}, ["new"], []),
])
def test_identities(spark, previous, groups, states, kinds):
    old = spark.createDataFrame([("d", uid(e), uid(c)) for c, es in previous.items() for e in es], "domain string, event_id string, canonical_id string")
    sizes = spark.createDataFrame([("d", uid(c), len(es)) for c, es in previous.items()], "domain string, canonical_id string, size int")
    ids, lineage = K.identities(members(spark, groups), old, sizes, "b1")
    got = ids.collect()
    assert sorted(r["state"] for r in got) == states and sorted(r["relation_type"] for r in lineage.collect()) == kinds
    assert all((r["canonical_id"] == uid(70)) == (r["state"] == "retained") for r in got)


def stories(spark, records):
    st = Stages(spark, "test")
    df = spark.createDataFrame(records, RECORD)
    m, g = K.canonicalize(st, df, neighbours(spark, []))
    nodes = st.write(S.profiles(K.prepare(df), m, g))
    s, mm, e = S.build_stories(st, nodes)
    return s.collect(), mm.collect(), e.join(S.scored_edges(st, nodes).select("source", "target", "relation_type"), ["source", "target"]).collect()


COMPANY = ("company", "acme", "Acme")


def stage(n, day, title, summary, **more):
    return record(n, title=title, summary=summary, day=day, kind="product", entity=COMPANY, vector=(1.0, 0.02 * n), **more)


def test_a_story_of_phases(spark):
    s, m, e = stories(spark, [stage(1, 10, "Acme announced battery factory in Ohio", "battery factory project capacity"), stage(2, 20, "Acme battery factory approved in Ohio", "battery factory project capacity approved"), stage(3, 30, "Acme started battery factory in Ohio", "battery factory project capacity implemented")])
    assert len(s) == 1 and len(m) == 3 and s[0]["quality_score"] >= 0.76 and {x["relation_type"] for x in e} == {"continuation"}
    assert [x["position"] for x in sorted(m, key=lambda r: r["position"])] == [0, 1, 2]


def test_no_story_without_progress_or_evidence(spark):
    assert stories(spark, [stage(1, 10, "Acme battery news", "battery factory"), stage(2, 20, "Acme battery report", "battery factory")])[0] == []
    assert stories(spark, [stage(1, 10, "Acme announced battery factory", "battery factory project", proof=""), stage(2, 20, "Acme battery factory approved", "battery factory project")])[0] == []


def test_story_identities_follow_overlap(spark, rows):
    make = lambda d: spark.createDataFrame([("a", s, c) for s, cs in d.items() for c in cs], "anchor_key string, story string, canonical_id string")
    got = S.story_identities(Stages(spark, "t"), make({"n1": "abc", "n2": "xy", "n3": "q"}), make({"o1": "abd", "o2": "xyz"}))
    assert rows(got, "story", "identity", "state") == [("n1", "o1", "retained"), ("n2", "o2", "retained"), ("n3", "n3", "new")]


def test_material_form_ignores_order(spark):
    q = lambda members, revs, maturity="emerging": spark.sql(f"SELECT array({members}) m, '{maturity}' x, array(named_struct('source','a','target','b','relation_type','causes','direction','','status','ok','revisions',array({revs}),'claims',array('c'))) e").select(S.material_form(*[__import__('pyspark.sql', fromlist=['functions']).functions.col(c) for c in "mxe"])).first()[0]
    base = q("'a','b'", "'r1','r2'")
    assert base == q("'a','b'", "'r2','r1'") and base != q("'b','a'", "'r1','r2'") and base != q("'a','b'", "'r1'") and base != q("'a','b'", "'r1','r2'", "established")


def test_matching_equals_a_greedy_pass(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(f"a{rng.integers(12)}", f"b{rng.integers(12)}") for _ in range(50)})
    order = rng.permutation(len(pairs)).tolist()
    used, want = set(), set()
    for o, (a, b) in sorted(zip(order, pairs)):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame([(a, b, o) for o, (a, b) in zip(order, pairs)], "a string, b string, o int")
    assert {(r["a"], r["b"]) for r in greedy_matching(Stages(spark, "t"), df, "a", "b", "o").collect()} == want


def test_components(spark):
    df = spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in labelled_components(Stages(spark, "t"), df, "a", "b").collect()}
    assert set(got.values()) == {"0", "x"} and len(got) == 11


def test_diverse_cards(spark):
    df = spark.createDataFrame([("p", f"e{i:02d}", f"s{i % 3}", 100 - i) for i in range(12)] + [("q", "only", "s", 1)], "playlist_id string, event_id string, source string, start_day int")
    got = diverse_cards(df).collect()
    p = [r for r in sorted(got, key=lambda r: r["place"]) if r["playlist_id"] == "p"]
    assert [r["event_id"] for r in p] == ["e00", "e01", "e02", "e03", "e04", "e05"] and len(got) == 7
