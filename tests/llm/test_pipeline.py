import importlib.util
import random

import corpus_pipeline

from .common import DOCS, components, linked, shingles, words
from .test_text_operators import SOUNDS, base_secrets, speech


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, speech(rng, SOUNDS[lang], rng.randint(40, 90)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    item = " ".join(words(rng, 25))
    rows += [(300, rows[0][1], "aa"), (301, rows[2][1] + " extra", "aa"), (302, None, "aa"), (303, "", None), (304, "123 456", None), (305, rows[4][1] + " " + item, "aa"), (306, speech(rng, SOUNDS["bb"], 60) + " password=hunter2222", "bb")]
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "a", "b") for i, t, lang in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, here = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, here, str(tmp_path)).write.parquet(out)
        here = spark.read.parquet(out)
        seen[name] = here
        assert name == "packing" or here.columns == docs.columns
    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in seen.items()}
    text = {i: t for i, t, _ in rows}
    assert sorted(ids["language_id"]) == sorted(set(text) - {302, 303, 304})
    order = sorted(ids["language_id"])
    sets = [shingles(text[i]) for i in order]
    comp = components(len(order), [(a, b) for a in range(len(order)) for b in range(a) if linked(sets[a], sets[b])])
    assert sorted(ids["near_dedup"]) == sorted({order[c] for c in comp})
    assert sorted(ids["decontamination"]) == sorted(set(ids["near_dedup"]) - {305})
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert sorted(clean) == sorted(ids["decontamination"]) and not base_secrets(clean[306]["text"]) and clean[306]["n_chars"] == len(clean[306]["text"])
    assert all(clean[i]["text"] == text[i] for i in clean if i != 306)
    assert set(ids["packing"]) == set(clean)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert importlib.util.find_spec("corpus_pipeline") and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "packing"]
