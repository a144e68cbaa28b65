"""Files, gold sentences, lexicons, vectors, recurrent models and the command line."""

import json
import math

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from quern import cli
from quern.config import load_as
from quern.operators import boundaries, embeddings, lexicon, recurrent
from quern.operators.learning import mcnemar
from quern.sources import files


def test_documents_pass_unknown_keys_through(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"url": "u", "text": "a", "more": 1}\n\n{"url": "v", "text": null}\n', encoding="utf-8")
    rows = files.read_documents(spark, str(path))
    assert sorted(rows.columns) == ["more", "text", "url"] and rows.count() == 2
    files.write_documents(rows, str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out")).count() == 2
    path.write_text("no json\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.read_documents(spark, str(path), files.DOCUMENT).collect()


def test_small_files(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c\"", 5)], "word string, cnt long")
    files.write_counts(counts, str(tmp_path / "v"))
    assert {tuple(r) for r in files.read_counts(spark, str(tmp_path / "v")).collect()} == {("b", 2), ("a", 2), ("c\"", 5)}
    files.write_merges(spark, [("a", "b"), ("ab", "</w>")], str(tmp_path / "m"))
    assert [(r.rank, r.a, r.b) for r in files.read_merges(spark, str(tmp_path / "m")).orderBy("rank").collect()] == [(1, "a", "b"), (2, "ab", "</w>")]
    (tmp_path / "vec.txt").write_text("2 3\nx 1 2 3\ny 4 oops 6\nz 7 8 9\n", encoding="utf-8")
    assert {r.word: r.vec for r in files.read_vectors(spark, str(tmp_path / "vec.txt")).collect()} == {"x": [1, 2, 3], "z": [7, 8, 9]}
    (tmp_path / "r.csv").write_text('review;sentiment\n"good; ""very"""; positive\nbad;negative\nodd;neutral\n', encoding="utf-8")
    assert {tuple(r) for r in files.read_reviews(spark, str(tmp_path / "r.csv")).collect()} == {('good; "very"', 1), ("bad", 0)}
    files.write_report({"x": math.inf, "t": counts.orderBy("word")}, str(tmp_path / "r.json"))
    assert files.read_report(str(tmp_path / "r.json")) == {"x": float("inf"), "t": [{"word": w, "cnt": c} for w, c in (("a", 2), ("b", 2), ("c\"", 5))]}


GOLD = f"""=== SAMPLE 1 ===
URL: x
{files.GOLD}
One is here. Two
follows! Three?

=== SAMPLE 2 ===
{files.GOLD}
{files.GOLD_NONE}
"""


def test_gold_sentences(spark):
    raw = spark.createDataFrame([(GOLD,)], "value string").select(files.gold_blocks(F.col("value")).alias("b")).first().b
    assert raw == [["One is here. Two", "follows! Three?"], []]
    blocks = spark.createDataFrame([(1, ["One is here.", "Two follows!", "Three?"]), (2, raw[0])], "sample int, lines array<string>")
    counts = boundaries.against_gold(blocks)
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 0, 0), (2, 0, 2, 1)}
    t = boundaries.totals(counts).first()
    assert (t.samples, t.tp, t.fp, t.fn) == (2, 2, 2, 1) and abs(t.f1 - 4 / 7) < 1e-12


def test_lexicon_scores(spark):
    words = spark.createDataFrame([(1, w) for w in ("good", "good", "bad", "day")] + [(2, "day")], "doc_id long, word string")
    known = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    got = {r.doc_id: r for r in lexicon.scores(words, known).collect()}
    assert np.allclose(got[1][1:], [6 / 9, 2 / 9, 1 / 9, 3 / math.sqrt(9 + 15)]) and np.allclose(got[2][1:], [0, 0, 1, 0])


def test_factors_learn_cooccurrence(spark):
    pairs = [(a, b, 50.0 if (a < "c") == (b < "c") else 0.1) for a in "abcd" for b in "abcd" if a != b]
    rows = spark.createDataFrame(pairs, "w1 string, w2 string, weight double")
    vec = {r.word: np.array(r.vec) for r in embeddings.factorise(rows, 6, 40, 0.1, most=1.0).collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert cos("a", "b") > cos("a", "c") and cos("c", "d") > cos("b", "c")


def test_reduced_keeps_the_table(spark):
    table = np.array([[0, 2, 1], [2, 0, 0], [1, 0, 3.0]])
    rows = [(a, b, float(table[i, j])) for i, a in enumerate("abc") for j, b in enumerate("abc") if table[i, j]]
    vec = {r.word: r.vec for r in embeddings.reduced(spark.createDataFrame(rows, "w1 string, w2 string, x double"), "x", 3).collect()}
    x = np.array([vec[w] for w in "abc"])
    assert x.shape == (3, 2) and np.allclose((x**2).sum(axis=0), np.sort(np.linalg.svd(table)[1])[::-1][:2] ** 2)


@pytest.mark.parametrize("kind", recurrent.KINDS)
def test_recurrent_gradients(kind):
    rng = np.random.default_rng(1)
    net = recurrent.Recurrent(kind, 3, 4)
    x, y, weight = rng.normal(size=(5, 6)), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5])
    grad = net.gradients(x, y, weight)[1]
    for name, p in net.p.items():
        at = tuple(int(rng.integers(n)) for n in p.shape)
        was, found = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = was + step
            found.append(net.gradients(x, y, weight)[0])
        p[at] = was
        assert abs((found[0] - found[1]) / 2e-5 - grad[name][at]) < 1e-6


def test_recurrent_grid(spark):
    rng = np.random.default_rng(2)
    rows = [("f", k, ("train", "train", "dev", "test")[k % 4], k % 2, (rng.normal(size=4) + 3 * (k % 2)).tolist()) for k in range(0, 200)]
    rows = [(f, k, ("train", "dev", "test")[(k // 2) % 3], y, v) for f, k, _, y, v in rows]
    got = recurrent.train_grid(spark.createDataFrame(rows, "feature string, doc_id long, split string, y int, vec array<double>"), ("rnn", "lstm"), 8, 20, rate=0.02).collect()
    assert {r.model for r in got} == {"rnn", "lstm"}
    assert sum(r.y == r.prediction for r in got) > 0.9 * len(got)


def test_recurrent_grid_reads_all_test_rows(spark):
    rows = [("f", k, ("train", "dev", "test")[k % 3], k // 3 % 2, [float(k // 3 % 2), 1.0]) for k in range(90)]
    got = recurrent.train_grid(spark.createDataFrame(rows, "feature string, doc_id long, split string, y int, vec array<double>"), ("rnn",), 4, 1, most=5)
    assert sorted(r.doc_id for r in got.collect()) == list(range(2, 90, 3))


def test_mcnemar():
    assert mcnemar(0, 0) == 1.0 and abs(mcnemar(1, 9) - 22 / 1024) < 1e-12


def test_settings(tmp_path):
    from dataclasses import dataclass
    from pathlib import Path

    @dataclass(frozen=True)
    class Settings:
        out: Path
        n: int = 3

    globals()["Settings"] = Settings
    (tmp_path / "s.yaml").write_text("out: a/b\nelse: 1\n", encoding="utf-8")
    assert load_as(tmp_path / "s.yaml", Settings) == Settings(Path("a/b"), 3)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    say = ["red fox runs. The dog sleeps here!", "blue sky over sea. Waves roll. Ships sail", "red dog and fox. They run fast."]
    with (top / "raw.jsonl").open("w", encoding="utf-8") as out:
        for k in range(60):
            row = {"url": f"https://x.example/{k}", "text": f"{say[k % 3]} {say[(k // 3) % 3]}", "category": "c", "subcategory": "ab"[k % 2], "datetime_raw": "09:05, 3 Mamyr 2024"}
            out.write(json.dumps(row) + "\n")
    return top


def run(top, name, **settings):
    path = top / "settings.yaml"
    path.write_text(yaml.safe_dump({k: str(v) if not isinstance(v, (int, float, bool, list)) else v for k, v in settings.items()}), encoding="utf-8")
    return cli.main([*name.split(), "--config", str(path)])


def test_command_line(spark, corpus):
    assert len(cli.TASKS) == 27
    docs = corpus / "norm"
    run(corpus, "preprocess clean", inp_jsonl=corpus / "raw.jsonl", out_jsonl=corpus / "clean")
    run(corpus, "preprocess metadata", inp_jsonl=corpus / "clean", out_jsonl=docs)
    assert run(corpus, "qc audit-raw", raw_jsonl=corpus / "raw.jsonl")["missing"][0]["title"] == 60
    got = run(corpus, "qc corpus-summary", processed_jsonl=docs, out_md=corpus / "s.md")
    assert got["dates"][0]["first"].startswith("2024-05-03") and (corpus / "s.md").exists()
    assert run(corpus, "task tokenize", inp_jsonl=docs, top_k=3)["top"][0]["token"] == "."
    assert run(corpus, "task vocab", inp_jsonl=docs, out_tsv=corpus / "v")["types"] == 19
    assert 0 < run(corpus, "task heaps", inp_jsonl=docs, sample_every_tokens=5)["fit"][0]["beta"] < 1
    run(corpus, "task heaps-plot", inp_jsonl=docs, out_img=corpus / "h.png")
    assert run(corpus, "task bpe-train", inp_jsonl=docs, merges=5, out_merges=corpus / "m")["merges"] == 5
    assert run(corpus, "task bpe-apply-examples", inp_jsonl=docs, merge_file=corpus / "m", min_len=3)["examples"]
    assert run(corpus, "task sentseg", inp_jsonl=docs)["stats"][0]["docs"] == 60
    (corpus / "gold.txt").write_text(GOLD, encoding="utf-8")
    assert run(corpus, "task sentseg-eval", gold_path=corpus / "gold.txt")["total"][0]["samples"] == 1
    assert run(corpus, "task spell-lev-demo", vocab_file=corpus / "v", demo_words=["rde"])["suggestions"][0]["word"] == "red"
    assert run(corpus, "task spell-lev-eval", vocab_file=corpus / "v", n_test=5, min_word_len=4)["accuracy"][0]["n"] == 5
    assert run(corpus, "task confusion-synth", vocab_path=corpus / "v", out_path=corpus / "c", n_samples=200)["pairs"] > 0
    assert run(corpus, "task confusion-top", inp_path=corpus / "c", top_n=3, out_dir=corpus)["top"][0]["rank"] == 1
    weighted = {"vocab_file": corpus / "v", "conf_file": corpus / "c"}
    assert run(corpus, "task spell-weighted-demo", demo_words=["zed"], **weighted)["suggestions"]
    assert run(corpus, "task spell-weighted-eval", n_test=5, min_word_len=4, **weighted)["accuracy"][0]["n"] == 5


def test_command_line_models(spark, corpus):
    raw = {"inp_jsonl": corpus / "raw.jsonl", "text_field": "text"}
    assert run(corpus, "task p2-ngram", **raw)["perplexity"]
    assert run(corpus, "task p2-smoothing", **raw)["best"]
    assert run(corpus, "task p2-dot-lr", **raw)["best"] in ("l1", "l2")
    assert run(corpus, "task p3-dataset", **raw)["docs"] == 60
    small = {"vector_size": 4, "epochs": 1, "max_iter": 2}
    run(corpus, "task p3-word2vec", out_json=corpus / "a.json", **small, **raw)
    run(corpus, "task p3-glove", out_json=corpus / "b.json", **small, **raw)
    assert 0 <= run(corpus, "task p3-compare", word2vec_json=corpus / "a.json", glove_json=corpus / "b.json")["mean_jaccard"] <= 1
    assert run(corpus, "task p3-classify", pmi_vector_size=4, hidden_size=4, epochs=1, **raw)["lstm"]
