import random

import pytest

from strandflow.llm import near_dedup
from strandflow.llm.components import connected_components
from strandflow.llm.near_dedup import near_duplicates

from .common import components, corpus, frame, linked, shingles, words


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])]
    comp = components(len(rows), links)
    least = {}
    for c, (doc, _) in zip(comp, rows):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return sorted(((doc, len(s), least.get(c)) for (doc, _), s, c in zip(rows, sets, comp)), key=repr)


def result(df):
    return sorted(((r["_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_equals_brute_force_on_awkward_rows(spark):
    rows = corpus()
    found = near_duplicates(frame(spark, rows), keep_rows=True)
    assert result(found) == brute(rows)
    kept = found.where("is_first").collect()
    assert len(kept) == len({id(r) for r in kept}) and {"doc_id", "_rid", "hits"} <= set(kept[0]["_row"].asDict())
    assert sum(r["_id"] in (10, 11, 12, 20) for r in kept) == 1


def test_equals_brute_force_on_a_hard_group(spark, monkeypatch):
    """Many variants at similarities around the threshold, and one passage in unrelated texts; tiny blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(5)
    base, passage = words(rng, 60), words(rng, 40)
    rows = []
    for i in range(90):
        v = list(base)
        for j in rng.sample(range(60), rng.randint(1, 4)):
            v[j] = rng.choice(passage)
        rows.append((i, " ".join(v)))
    rows += [(200 + i, " ".join(words(rng, 25) + passage + words(rng, rng.randint(0, 25)))) for i in range(40)]
    assert result(near_duplicates(frame(spark, rows))) == brute(rows)


def test_members_of_long_lists_meet_once_and_copies_of_a_list_cost_nothing(spark, monkeypatch):
    """Every pair from different components meets in the list of its least shared value; lists of the same members are dealt out once."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(3)
    schema = "_rid long, n_shingles long, sketch array<long>, heads array<long>, comp long"

    def dealt(heads, comp):
        rows = [(i, 100, sorted(h), sorted(h), c) for i, (h, c) in enumerate(zip(heads, comp))]
        return near_dedup._meetings(spark.createDataFrame(rows, schema)).collect()

    same = dealt([list(range(15))] * 60, range(60))
    assert {r["v"] for r in same} == {0} and len(same) == 60 * 9  # before: 15 times as many
    heads = [[v for v in range(15) if rng.random() < 0.85] + [100 + i // 5] for i in range(80)]
    comp = [0 if rng.random() < 0.5 else i for i in range(80)]
    rows = dealt(heads, comp)
    blocks = {}
    for r in rows:
        blocks.setdefault((r["v"], r["i"], r["j"]), []).append((r["side"], r["_rid"]))
    met = set()
    for (v, i, j), members in blocks.items():
        assert len(members) == len(set(members)) and all(side == 0 for side, _ in members) or i < j
        met |= {(v, *sorted((a, b))) for x, a in members for y, b in members if a != b and (x != y if i < j else True)}
    for a in range(80):
        for b in range(a + 1, 80):
            shared = set(heads[a]) & set(heads[b])
            assert comp[a] == comp[b] or not shared or (min(shared), a, b) in met
    lists = [[i for i in range(80) if v in heads[i]] for v in range(15)]
    assert len(rows) < sum(len(x) * -(-len(x) // 7) for x in lists) / 1.5


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_bounds_are_safe():
    table = near_dedup.required_table()
    assert table[64] == 43 and table[-1] == 26 and all(table[n] <= n for n in range(len(table)))
    assert table[64:] == sorted(table[64:], reverse=True)


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(1, 1), (1, 2)], {1: 1, 2: 1}), ([(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 100)], {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100})])
def test_components(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
