"""Command line: every task of the engine, each with one YAML file of settings.

    python -m quern.cli task vocab --config vocab.yaml

A task reads and writes the files that its settings name and prints its report
as JSON. Settings that a task doesn't know are left out.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import load_yaml
from .functions import text as T
from .functions import vectors as V
from .operators import boundaries, embeddings, recurrent
from .operators import classification as K
from .operators import corpus as C
from .operators import dots as D
from .operators import learning as L
from .operators import matrices as M
from .operators import ngrams as N
from .operators import spelling as S
from .operators import subwords as B
from .sources import files, pages

Task = Callable[[SparkSession, dict], dict]
TASKS: dict[tuple[str, ...], Task] = {}
FIELDS = ("url", "domain", "title", "datetime_raw", "text", "scraped_at", "lang_script", "source", "category", "subcategory")


def task(*path: str) -> Callable[[Task], Task]:
    def put(fn: Task) -> Task:
        TASKS[path] = fn
        return fn

    return put


def documents(spark: SparkSession, cfg: dict) -> DataFrame:
    """doc_id (a number in the order of the file), text, category and subcategory."""
    rows = files.read_documents(spark, str(cfg["inp_jsonl"]))
    for name in ("category", "subcategory"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.withColumn("doc_id", F.monotonically_increasing_id())
    out = C.load_documents(
        rows, text=cfg.get("text_field", "clean_text"), category="category", subcategory=cfg.get("label_field", "subcategory"),
        remove_timestamps=cfg.get("remove_timestamps", False),
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def words(spark: SparkSession, cfg: dict) -> DataFrame:
    return C.exploded(documents(spark, cfg), T.words(F.col("text"), cfg.get("lowercase", True)), "word")


def report(cfg: dict, **parts) -> dict:
    """The parts, written to ``out_json`` if the settings name it."""
    made = {k: v.collect() if isinstance(v, DataFrame) else v for k, v in parts.items()}
    made = files.plain(made)
    if cfg.get("out_json"):
        files.write_report(made, str(cfg["out_json"]))
    return made


# ---------------------------------------------------------------- pages and preparation


@task("scrape")
def scrape(spark: SparkSession, cfg: dict) -> dict:
    """From a table of fetched pages (``pages_path``: page_id, url, html): new articles are added to ``out_jsonl``."""
    found = pages.bodies(spark.read.parquet(str(cfg["pages_path"])), cfg.get("min_text_len", 250), cfg.get("drop", ""))
    out = str(cfg["out_jsonl"])
    if files.exists(spark, out):
        found = pages.unseen(found, files.read_documents(spark, out))
    found = found.persist()
    files.write_documents(found, out, "append")
    if cfg.get("out_txt"):
        files.write_texts(found, str(cfg["out_txt"]))
    return report(cfg, saved=found.count(), by_domain=found.groupBy("domain").count().orderBy(F.desc("count"), "domain"))


@task("preprocess", "clean")
def clean(spark: SparkSession, cfg: dict) -> dict:
    on = [cfg.get(k, True) for k in ("remove_header_line", "remove_urls", "remove_twitter", "normalize_whitespace")]
    rows = files.read_documents(spark, str(cfg["inp_jsonl"]))
    files.write_documents(rows.withColumn("clean_text", T.clean_text(F.col("text"), *on)), str(cfg["out_jsonl"]))
    return report(cfg, written=str(cfg["out_jsonl"]))


@task("preprocess", "metadata")
def metadata(spark: SparkSession, cfg: dict) -> dict:
    rows = files.read_documents(spark, str(cfg["inp_jsonl"]))
    raw = F.col("datetime_raw") if "datetime_raw" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("doc_id", T.doc_key(F.col("url")))
    rows = rows.withColumn("published_at_iso", T.published_iso(raw, cfg.get("default_gmt_offset_hours", 5)))
    files.write_documents(rows, str(cfg["out_jsonl"]))
    return report(cfg, written=str(cfg["out_jsonl"]))


@task("qc", "audit-raw")
def audit_raw(spark: SparkSession, cfg: dict) -> dict:
    path, wanted = str(cfg["raw_jsonl"]), cfg.get("required_fields", FIELDS)
    keys = F.json_object_keys("value")
    missing = files.read_lines(spark, path).agg(*(F.count_if(~F.coalesce(F.array_contains(keys, k), F.lit(False))).alias(k) for k in wanted))
    rows = files.read_documents(spark, path, files.DOCUMENT).persist()
    size = F.coalesce(F.length("text"), F.lit(0))
    twice = rows.groupBy("url").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1").orderBy(F.desc("cnt"), "url").limit(20)
    longest = rows.select("url", size.alias("n")).orderBy(F.desc("n"), "url").limit(5)
    empty = rows.agg(*(F.count_if(F.col(k).isNull() | (F.trim(k) == "")).alias(k) for k in FIELDS))
    return report(cfg, docs=rows.count(), missing=missing, empty=empty, lengths=C.length_stats(rows, size), duplicate_urls=twice, longest=longest)


@task("qc", "corpus-summary")
def corpus_summary(spark: SparkSession, cfg: dict) -> dict:
    rows = files.read_documents(spark, str(cfg["processed_jsonl"])).persist()
    groups = rows.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "category", "subcategory")
    lengths = C.length_stats(rows, F.coalesce(F.length("clean_text"), F.lit(0)))
    dates = rows.agg(F.min("published_at_iso").alias("first"), F.max("published_at_iso").alias("last"))
    if cfg.get("out_md"):
        target = Path(str(cfg["out_md"]))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n\n".join(files.markdown(x) for x in (lengths, dates, groups)) + "\n", encoding="utf-8")
    return report(cfg, docs=rows.count(), lengths=lengths, dates=dates, categories=groups)


# ---------------------------------------------------------------- counts


@task("task", "tokenize")
def tokenize(spark: SparkSession, cfg: dict) -> dict:
    items = C.exploded(documents(spark, cfg), T.tokens(F.col("text"), cfg.get("lowercase", True)), "token")
    counts = C.frequencies(items, "token").persist()
    size = counts.agg(F.sum("cnt").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"))
    return report(cfg, size=size, top=C.top(counts, "token", cfg.get("top_k", 30)))


@task("task", "vocab")
def vocab(spark: SparkSession, cfg: dict) -> dict:
    counts = C.frequencies(words(spark, cfg), "word").persist()
    files.write_counts(counts, str(cfg["out_tsv"]))
    return report(cfg, types=counts.count(), top=C.top(counts, "word", cfg.get("top_k_print", 20)))


def _growth(spark: SparkSession, cfg: dict) -> DataFrame:
    from .plans.corpus import growth

    return growth(documents(spark, cfg), cfg.get("sample_every_tokens", 200)).persist()


@task("task", "heaps")
def heaps(spark: SparkSession, cfg: dict) -> dict:
    y, x = F.log("n_types"), F.log("n_tokens")
    fit = _growth(spark, cfg).agg(
        F.regr_slope(y, x).alias("beta"), F.exp(F.regr_intercept(y, x)).alias("k"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("points")
    )
    return report(cfg, fit=fit)


@task("task", "heaps-plot")
def heaps_plot(spark: SparkSession, cfg: dict) -> dict:
    """The points of the chart as a table beside ``out_img``."""
    out = str(Path(str(cfg["out_img"])).with_suffix(".csv"))
    _growth(spark, cfg).orderBy("n_tokens").coalesce(1).write.mode("overwrite").option("header", "true").csv(out)
    return report(cfg, written=out)


@task("task", "bpe-train")
def bpe_train(spark: SparkSession, cfg: dict) -> dict:
    """Up to ``local_words`` distinct words are trained on by the driver, more of them by Spark."""
    counts, most = C.frequencies(words(spark, cfg), "word").persist(), cfg.get("local_words", 200_000)
    some = [(r.word, r.cnt) for r in counts.limit(most + 1).collect()]
    merges = B.train_local(some, cfg.get("merges", 1000)) if len(some) <= most else B.train(counts, cfg.get("merges", 1000))
    files.write_merges(spark, merges, str(cfg["out_merges"]))
    return report(cfg, merges=len(merges), first=merges[:10])


@task("task", "bpe-apply-examples")
def bpe_apply(spark: SparkSession, cfg: dict) -> dict:
    merges = [(r.a, r.b) for r in files.read_merges(spark, str(cfg["merge_file"])).orderBy("rank").collect()]
    fit = words(spark, cfg).where(F.length("word").between(cfg.get("min_len", 6), cfg.get("max_len", 14)))
    some = fit.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at")).orderBy("at").limit(cfg.get("examples", 10))
    return report(cfg, examples=B.apply(some, merges))


@task("task", "sentseg")
def sentseg(spark: SparkSession, cfg: dict) -> dict:
    docs = documents(spark, cfg)
    n = docs.select(F.size(T.sentences(F.col("text"))).alias("n"))
    stats = n.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))
    first = F.slice(T.sentences(F.col("text")), 1, cfg.get("sentences_per_doc_for_examples", 2))
    some = C.exploded(docs, first, "sentence").orderBy("doc_id", "pos").limit(cfg.get("sample_sentences", 10))
    return report(cfg, stats=stats, examples=some)


@task("task", "sentseg-eval")
def sentseg_eval(spark: SparkSession, cfg: dict) -> dict:
    whole = spark.read.text(str(cfg["gold_path"]), wholetext=True)
    blocks = whole.select(F.posexplode(files.gold_blocks(F.col("value"))).alias("sample", "lines")).where(F.size("lines") > 0)
    if blocks.isEmpty():
        raise ValueError("the file holds no marked sentences")
    counts = boundaries.against_gold(blocks).persist()
    return report(cfg, total=boundaries.totals(counts), samples=counts.orderBy("sample"))


# ---------------------------------------------------------------- spelling


def _suggested(vocab: DataFrame, asked: DataFrame, cfg: dict, confusions: DataFrame | None = None) -> DataFrame:
    reach, n = cfg.get("max_len_diff", 2), cfg.get("topn", 5)
    if confusions is None:
        found = S.candidates(asked, vocab, reach, cfg.get("require_same_first_letter", True))
        return S.suggest(found, F.levenshtein("query", "word"), n)
    found = S.weighted_nearest(asked, vocab, confusions, reach, n)
    return S.suggest(found, F.col("distance"), n)


def _confusions(spark: SparkSession, cfg: dict) -> DataFrame:
    return files.read_confusions(spark, str(cfg["conf_file"]))


def _demo(spark: SparkSession, cfg: dict, confusions: DataFrame | None) -> dict:
    asked = spark.createDataFrame([(w,) for w in cfg.get("demo_words", [])], "query string")
    found = _suggested(files.read_counts(spark, str(cfg["vocab_file"])), asked, cfg, confusions)
    return report(cfg, suggestions=found.select("query", "rank", "word", "distance", "cnt").orderBy("query", "rank"))


def _evaluated(spark: SparkSession, cfg: dict, confusions: DataFrame | None) -> dict:
    counts, seed = files.read_counts(spark, str(cfg["vocab_file"])).persist(), F.lit(str(cfg.get("seed", 42)))
    known = counts.where(F.length("word") >= cfg.get("min_word_len", 5))
    drawn = known.orderBy(F.md5(F.concat_ws("~", seed, "word").cast("binary"))).limit(cfg.get("n_test", 300))
    truth = drawn.select("word", T.typo(F.col("word"), seed, cfg.get("alphabet", S.ALPHABET)).alias("query")).persist()
    found = _suggested(counts, truth.select("query").distinct(), cfg, confusions)
    return report(cfg, accuracy=S.accuracy(found, truth, cfg.get("topn", 5)))


@task("task", "spell-lev-demo")
def spell_lev_demo(spark: SparkSession, cfg: dict) -> dict:
    return _demo(spark, cfg, None)


@task("task", "spell-lev-eval")
def spell_lev_eval(spark: SparkSession, cfg: dict) -> dict:
    return _evaluated(spark, cfg, None)


@task("task", "spell-weighted-demo")
def spell_weighted_demo(spark: SparkSession, cfg: dict) -> dict:
    return _demo(spark, cfg, _confusions(spark, cfg))


@task("task", "spell-weighted-eval")
def spell_weighted_eval(spark: SparkSession, cfg: dict) -> dict:
    return _evaluated(spark, cfg, _confusions(spark, cfg))


@task("task", "confusion-synth")
def confusion_synth(spark: SparkSession, cfg: dict) -> dict:
    known = files.read_counts(spark, str(cfg["vocab_path"])).where(F.length("word") >= cfg.get("min_word_len", 4))
    made = S.synthetic_confusions(
        C.ranked(known.select("word"), ["word"]), cfg.get("n_samples", 12000), cfg.get("seed", 42), cfg.get("min_word_len", 4), cfg.get("confusable_prob", 0.85)
    ).persist()
    rows = made.orderBy(F.desc("cnt"), "a", "b")
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(str(cfg["out_path"]))
    return report(cfg, pairs=made.count())


@task("task", "confusion-top")
def confusion_top(spark: SparkSession, cfg: dict) -> dict:
    rows = S.shares(files.read_confusions(spark, str(cfg["inp_path"]))).orderBy(F.desc("cnt"), "a", "b").limit(cfg.get("top_n", 20))
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "a", "b"))
    rows = rows.select(rank.alias("rank"), "a", "b", F.col("cnt").alias("count"), F.col("p").alias("p_b_given_a"))
    if cfg.get("out_dir"):
        files.ranked_table(rows, f"{cfg['out_dir']}/confusion_top{cfg.get('top_n', 20)}")
    return report(cfg, top=rows)


# ---------------------------------------------------------------- models of texts


def _events(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """sentences (split, words) and the vocabulary of the train split."""
    docs = documents(spark, cfg)
    split = C.split(docs.select("doc_id"), cfg.get("seed", 42), cfg.get("train_ratio", 0.8), cfg.get("dev_ratio", 0.1))
    rows = docs.join(split, "doc_id").select("split", F.explode(T.sentence_words(F.col("text"))).alias("words")).persist()
    return rows, N.vocabulary(rows, cfg.get("min_count", 2)).persist()


def _probabilities(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, known = _events(spark, cfg)
    weights = tuple(cfg.get(f"interpolation_l{k}", w) for k, w in ((1, 0.1), (2, 0.3), (3, 0.6)))
    size = known.agg((F.count(F.lit(1)) + 3).alias("v"))
    scored = N.probabilities(N.events(rows, known).persist(), size, cfg.get("laplace_alpha", 1.0), weights, cfg.get("backoff_gamma", 0.4), cfg.get("kn_discount", 0.75))
    return rows, known, scored.persist()


@task("task", "p2-ngram")
def p2_ngram(spark: SparkSession, cfg: dict) -> dict:
    rows, known, scored = _probabilities(spark, cfg)
    top = {}
    for n in (1, 2, 3):
        cols = ["h1", "h2", "w"][3 - n :]
        seen = N.events(rows, known, n).where("split = 'train'")
        top[f"top_{n}"] = seen.select(*cols, F.col("m").alias("cnt")).orderBy(F.desc("cnt"), *cols).limit(cfg.get("top_k", 20))
    return report(cfg, words=known.count(), perplexity=N.unsmoothed(scored), **top)


@task("task", "p2-smoothing")
def p2_smoothing(spark: SparkSession, cfg: dict) -> dict:
    _, known, scored = _probabilities(spark, cfg)
    table = N.perplexities(scored).persist()
    best = table.where("split = 'dev'").orderBy("ppl", "method").select("method", "ppl").limit(1)
    return report(cfg, words=known.count(), perplexity=table.orderBy("method", "split"), best=best)


@task("task", "p2-dot-lr")
def p2_dot_lr(spark: SparkSession, cfg: dict) -> dict:
    from pyspark.ml.functions import vector_to_array

    from .plans.dots import INPUTS

    docs = documents(spark, cfg)
    split = C.split(docs.select("doc_id"), cfg.get("seed", 42), cfg.get("train_ratio", 0.8), cfg.get("dev_ratio", 0.1))
    rows = D.examples(docs).join(split, "doc_id").persist()
    parts, models = {}, {}
    for name, l1 in (("l1", True), ("l2", False)):
        models[name] = L.dot_classifier(rows.where("split = 'train'"), INPUTS, l1)
        found = models[name].transform(rows).withColumn("p", vector_to_array("probability")[1])
        found = found.withColumn("prediction", D.vetoed((F.col("p") >= cfg.get("threshold", 0.5)).cast("int"))).persist()
        for s in ("train", "dev", "test"):
            parts[f"{name}_{s}"] = L.binary_metrics(found.where(F.col("split") == s)).first()
        parts[f"{name}_threshold"] = L.best_threshold(found.where("split = 'dev'")).first()
        wrong = found.where("split = 'test' and y <> prediction").orderBy("doc_id", "i")
        parts[f"{name}_errors"] = wrong.select("doc_id", "i", "y", "prediction", "snippet").limit(10).collect()
    best = "l1" if parts["l1_dev"].f1 >= parts["l2_dev"].f1 else "l2"
    return report(cfg, best=best, **parts)


@task("task", "p3-dataset")
def p3_dataset(spark: SparkSession, cfg: dict) -> dict:
    docs, rows = documents(spark, cfg), words(spark, cfg).persist()
    counts, least = C.frequencies(rows, "word").persist(), cfg.get("frequent_min_freq", 3)
    stats = counts.agg(
        F.sum("cnt").alias("words"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("cnt") == 1).alias("once"), F.count_if(F.col("cnt") == 2).alias("twice"),
        F.count_if(F.col("cnt") >= least).alias("frequent"),
    )
    top = C.top(counts, "word", cfg.get("top_n", 20)).persist()
    if cfg.get("out_dir"):
        for name, table in (("tdm", M.term_document(rows, top)), ("wwm", M.word_word(rows, top)), ("top", top)):
            table.write.mode("overwrite").option("header", "true").csv(f"{cfg['out_dir']}/{name}.csv")
    return report(cfg, docs=docs.where(F.trim("text") != "").count(), stats=stats, top=top)


def _neighbours(vectors: DataFrame, asked: list[str], n: int) -> DataFrame:
    """The ``n`` nearest words of each of a few words."""
    vec = vectors.select("word", F.transform("vec", lambda x: x.cast("double")).alias("e")).persist()
    few = vec.where(F.col("word").isin(asked)).select(F.col("word").alias("query"), F.col("e").alias("q"))
    rows = vec.crossJoin(F.broadcast(few)).where("word <> query").select("query", "word", V.cosine(F.col("q"), F.col("e")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _vector_report(cfg: dict, vectors: DataFrame, counts: DataFrame) -> dict:
    asked = cfg.get("target_words") or [r.word for r in C.top(counts, "word", 10).collect()]
    if cfg.get("out_dir"):
        vectors.write.mode("overwrite").parquet(f"{cfg['out_dir']}/vectors")
    near = _neighbours(vectors, asked, cfg.get("topn", 10)).orderBy("query", "rank")
    return report(cfg, target_words=asked, words=vectors.count(), similar_words=near)


@task("task", "p3-word2vec")
def p3_word2vec(spark: SparkSession, cfg: dict) -> dict:
    docs = documents(spark, cfg)
    rows = docs.select(F.explode(T.sentence_words(F.col("text"))).alias("words")).where(F.size("words") > 1)
    model = L.word_vectors(rows, cfg.get("vector_size", 100), cfg.get("window", 5), cfg.get("min_count", 3), cfg.get("epochs", 15), cfg.get("seed", 42))
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vec")).persist()
    return _vector_report(cfg, vectors, C.frequencies(words(spark, cfg), "word"))


@task("task", "p3-glove")
def p3_glove(spark: SparkSession, cfg: dict) -> dict:
    rows = words(spark, cfg).persist()
    counts = C.frequencies(rows, "word").where(F.col("cnt") >= cfg.get("vocab_min_count", 3)).persist()
    if cfg.get("reuse_existing_vectors") and cfg.get("existing_vectors_path"):
        vectors = files.read_vectors(spark, str(cfg["existing_vectors_path"]))
    else:
        known = C.top(counts, "word", cfg.get("max_words", embeddings.MOST_WORDS))
        listed = documents(spark, cfg).select(T.words(F.col("text"), cfg.get("lowercase", True)).alias("words"))
        pairs = M.windows(listed, known, cfg.get("window_size", 5), weighted=True).withColumnRenamed("cnt", "weight")
        vectors = embeddings.factorise(pairs, cfg.get("vector_size", 100), cfg.get("max_iter", 15), most=cfg.get("x_max", 100)).persist()
    return _vector_report(cfg, vectors, counts)


@task("task", "p3-compare")
def p3_compare(spark: SparkSession, cfg: dict) -> dict:
    a, b = (files.read_report(str(cfg[k])) for k in ("word2vec_json", "glove_json"))
    k, rows = cfg.get("overlap_top_k", 5), []
    near = [{}, {}]
    for side, found in zip(near, (a, b)):
        for r in found["similar_words"]:
            if r["rank"] <= k:
                side.setdefault(r["query"], set()).add(r["word"])
    for w in sorted(near[0].keys() | near[1].keys()):
        x, y = near[0].get(w, set()), near[1].get(w, set())
        rows.append({"word": w, "shared": sorted(x & y), "jaccard": len(x & y) / len(x | y) if x | y else None})
    known = [r["jaccard"] for r in rows if r["jaccard"] is not None]
    return report(cfg, words=rows, mean_jaccard=sum(known) / len(known) if known else None)


@task("task", "p3-classify")
def p3_classify(spark: SparkSession, cfg: dict) -> dict:
    """Every feature set with every model, best first; with ``predict_text`` also the best labels of a text,
    told by ``predict_feature`` fitted on train and dev."""
    docs = documents(spark, cfg).where(F.col("subcategory").isNotNull()).select("doc_id", F.col("subcategory").alias("label"), "text")
    rows = docs.withColumn("words", F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 2)).where(F.size("words") > 0).drop("text")
    rows = C.stratified(rows, "label", cfg.get("seed", 42), cfg.get("train_ratio", 0.8)).persist()
    s = K.Settings(
        cfg.get("count_max_features", 1000), cfg.get("pmi_vocab_size", 1000), cfg.get("pmi_window", 4), cfg.get("pmi_vector_size", 100), cfg.get("vector_epochs", 15),
        cfg.get("min_count", 3), cfg.get("baseline_c", 1.0), cfg.get("baseline_max_iter", 200), cfg.get("hidden_size", 64), cfg.get("epochs", 8),
    )
    table = K.compare(rows, tuple(cfg.get("features", K.FEATURES)), tuple(cfg.get("models", ("logistic", *recurrent.KINDS))), s).persist()
    weight, more = L.class_weights(rows.where("split = 'train'"), "label").select("label", "weight"), {}
    for kind in ("logistic", "multinomial", "bernoulli"):
        given = rows.join(F.broadcast(weight), "label") if kind == "logistic" else rows  # one row a class
        model = L.bag_classifier(given.where("split = 'train'"), kind, s.count_words)
        more[kind] = L.multiclass_metrics(model.transform(given.where("split = 'test'")))
    for kind in recurrent.KINDS:
        more[kind] = table.where(F.col("model") == kind)
    if cfg.get("predict_text"):
        words = spark.createDataFrame([(cfg["predict_text"],)], "text string").select(T.words(F.col("text")).alias("w")).first().w
        told = K.Predictor.fit(rows.where("split <> 'test'"), cfg.get("predict_feature", "tfidf"), s)
        more["prediction"] = told.predict_text(spark, [w for w in words if len(w) >= 2])
    return report(cfg, comparison=table, **more)


# ---------------------------------------------------------------- the parser


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern", description="Corpus analytics on Spark.")
    groups: dict[str, argparse._SubParsersAction] = {}
    top = parser.add_subparsers(dest="group", required=True)
    for path, fn in TASKS.items():
        if len(path) == 1:
            leaf = top.add_parser(path[0])
        else:
            if path[0] not in groups:
                groups[path[0]] = top.add_parser(path[0]).add_subparsers(dest="name", required=True)
            leaf = groups[path[0]].add_parser(path[1])
        leaf.add_argument("--config", required=True)
        leaf.set_defaults(func=fn)
    return parser


def main(argv: list[str] | None = None) -> dict:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    made = args.func(spark, load_yaml(args.config))
    print(json.dumps(made, ensure_ascii=False, indent=2, default=str))
    return made


if __name__ == "__main__":
    main()
