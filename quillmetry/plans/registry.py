"""The queries of the library over the driver's tables. Doubles are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.functions import text as T
from quillmetry.operators import baseline, diagnoses, distill, features, frames, issues, prep, reports, scoring, views
from quillmetry.session import spread, staged

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded to ``places``. At six, the precision of the data, halves of the last place are
    frequent and fall either way by the last bit of a sum; 2e-9 on top decides them alike everywhere."""
    bias = 2e-9 if places == 6 else 0.0
    return df.select(*((F.round(F.col(c) + bias, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.analysed(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def _features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return features.document_features(analysed(spark, sf_dir), "doc_id", keep)


def _group(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_features(spark, sf_dir).select("doc_id", *(f for f in C.FEATURE_GROUPS[name] if f != "rare_word_ratio")))

    query.__doc__ = f"The {name} features of each document."
    return query


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


def binyan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.binyan_distribution(analysed(spark, sf_dir), "doc_id")


def freq_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.frequency_dictionary(read(spark, sf_dir, "training_records"))


def rare_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = features.rare_words(analysed(spark, sf_dir), "doc_id", freq_dict(spark, sf_dir))
    return rounded(features.document_features(rare, "doc_id").select("doc_id", "rare_word_ratio"))


def _stats_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features with sentence metrics, staged since the baseline must exist before the issues, and the baseline."""
    rare = features.rare_words(analysed(spark, sf_dir), "doc_id", freq_dict(spark, sf_dir))
    wide = staged(features.document_features(rare, "doc_id", ("m", "sentences")), "features")
    return wide, baseline.feature_stats(baseline.long_features(wide.drop("m", "sentences"), "doc_id"))


def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stats_of_documents(spark, sf_dir)[1])


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "flat_features").select("doc_id", "feature", "value")


def feature_stats_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.feature_stats(_flat(spark, sf_dir)))


def feature_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = read(spark, sf_dir, "analysis_inputs").select(F.explode("raw_features").alias("feature", "value"))
    return rounded(baseline.feature_stats(_flat(spark, sf_dir).drop("doc_id").unionByName(more)))


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.with_scores(_features(spark, sf_dir)).select("doc_id", *C.SCORE_KEYS))


def normalized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.normalized_features(_features(spark, sf_dir), "doc_id").drop("rare_word_ratio"))


def _issues(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    wide, stats = _stats_of_documents(spark, sf_dir)
    return wide, issues.detect(scoring.with_scores(wide), staged(stats, "stats"), "doc_id", keep=keep)


def _joined(span: Column) -> Column:
    return F.array_join(F.transform(span, lambda x: x.cast("string")), "-")


def _span(df: DataFrame) -> DataFrame:
    return df.withColumn("span", _joined(F.col("span"))).drop("evidence")


def issue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues.issue_rows(_issues(spark, sf_dir)[1], "doc_id")
    return rounded(_span(rows).withColumn("emit_order", F.col("emit_order").cast("long")))


def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(issues.group_scores(issues.issue_rows(_issues(spark, sf_dir)[1], "doc_id"), "doc_id"))


def ranked_issues_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_span(issues.ranked(_issues(spark, sf_dir)[1], "doc_id")).withColumn("rank", F.col("rank").cast("long")))


def issue_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(issues.severity_vector(issues.issue_rows(_issues(spark, sf_dir)[1], "doc_id"), "doc_id"))


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnoses.diagnose(_issues(spark, sf_dir, tuple(C.SCORE_KEYS))[1], "doc_id")


def issue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that each issue is told from, read back from the JSON of the issues."""
    kind = "struct<issues:array<struct<type:string,span:array<int>,evidence:map<string,double>>>>"
    rows = issues.issues_json(_issues(spark, sf_dir)[1], "doc_id").select("doc_id", F.posexplode(F.from_json("json", kind)["issues"]).alias("emit_order", "x"))
    return rounded(rows.select("doc_id", F.col("emit_order").cast("long").alias("emit_order"), "x.type", F.explode("x.evidence").alias("name", "value")))


def issue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that the top-ranked issues of one sentence or two neighbours stand in."""
    wide, found = _issues(spark, sf_dir, ("sentences",))
    rows = issues.ranked(found, "doc_id").join(wide.select("doc_id", "sentences"), "doc_id").withColumn("sentence", issues.span_text(F.col("span"), F.col("sentences")))
    return rows.where("sentence is not null").select("doc_id", F.col("rank").cast("long").alias("rank"), F.md5(F.col("sentence")).alias("digest"))


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnoses.diagnose(_issues(spark, sf_dir, tuple(C.SCORE_KEYS))[1], "doc_id")


def issue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that each issue is told from, read back from the JSON of the issues."""
    kind = "struct<issues:array<struct<type:string,span:array<int>,evidence:map<string,double>>>>"
    rows = issues.issues_json(_issues(spark, sf_dir)[1], "doc_id").select("doc_id", F.posexplode(F.from_json("json", kind)["issues"]).alias("emit_order", "x"))
    return rounded(rows.select("doc_id", F.col("emit_order").cast("long").alias("emit_order"), "x.type", F.explode("x.evidence").alias("name", "value")))


def issue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that the top-ranked issues of one sentence or two neighbours stand in."""
    wide, found = _issues(spark, sf_dir, ("sentences",))
    rows = issues.ranked(found, "doc_id").join(wide.select("doc_id", "sentences"), "doc_id").withColumn("sentence", issues.span_text(F.col("span"), F.col("sentences")))
    return rows.where("sentence is not null").select("doc_id", F.col("rank").cast("long").alias("rank"), F.md5(F.col("sentence")).alias("digest"))


def weak_cohesion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weak_cohesion`` from sentence vectors: here the unit-long counts of tokens by length modulo 8."""
    wide, stats = _stats_of_documents(spark, sf_dir)
    counted = lambda lengths: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(lengths, lambda x: x == k)).cast("double"))
    lengths = lambda s: F.transform(T.tokens(s), lambda t: F.length(t) % 8)
    # Written between the steps, so that vectors aren't worked out again for each of their pairs.
    rows = staged(wide.withColumn("lengths", F.transform("sentences", lengths)), "lengths")
    rows = staged(rows.withColumn("vectors", F.transform("lengths", counted)).drop("lengths"), "vectors")
    rows = staged(baseline.with_similarities(rows, "vectors", "similar").drop("vectors"), "similar")
    long = rows.select("doc_id", F.lit("sentence_cosine_similarity").alias("feature"), F.explode("similar").alias("value"))
    found = issues.detect(rows, staged(stats.unionByName(baseline.feature_stats(long)), "stats"), "doc_id", similar="similar")
    table = issues.issue_rows(found, "doc_id").where("type = 'weak_cohesion'")
    return rounded(table.select("doc_id", F.col("span")[0].cast("long").alias("place"), "severity", "confidence", F.col("evidence")["cosine_similarity"].alias("similarity"), F.col("evidence")["jaccard"].alias("jaccard")))


def diagnosis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diagnoses(spark, sf_dir).select("doc_id", "type", "severity", "confidence"))


def diagnosis_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting issues, the number of their spans and the evidence of diagnoses, read back from the JSON of the interpretation."""
    kind = "struct<diagnoses:array<struct<type:string,supporting_issues:array<string>,supporting_spans:array<array<int>>,evidence:map<string,double>>>,interventions:array<struct<type:string,target_diagnosis:string,actions:array<string>,exercises:array<string>>>>"
    rows = diagnoses.interpretation_json(staged(_diagnoses(spark, sf_dir), "diagnoses"), "doc_id").select("doc_id", F.from_json("json", kind).alias("x"))
    rows = rows.select("doc_id", F.explode(F.arrays_zip(F.col("x.diagnoses").alias("d"), F.col("x.interventions").alias("i"))).alias("y")).select("doc_id", "y.d.*", "y.i.actions", "y.i.exercises")
    rows = rows.select("doc_id", "type", F.array_join("supporting_issues", ",").alias("issues"), F.size("supporting_spans").cast("long").alias("spans"), F.array_join(F.concat("actions", "exercises"), ";").alias("steps"), F.explode("evidence").alias("name", "value"))
    return rounded(rows)


def diagnosis_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(issues.severity_vector(_diagnoses(spark, sf_dir), "doc_id", C.DIAGNOSIS_KEYS))


def derived_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions derived from the diagnoses of training records."""
    rows = diagnoses.derived_interventions(read(spark, sf_dir, "training_records"), "record_id")
    return rounded(rows.select("record_id", "diagnosis", "intervention", "priority", F.array_join("actions", ";").alias("actions")))


def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training record of each document: scores, severities of all issues and diagnoses, sentence labels."""
    found = staged(_issues(spark, sf_dir, (*C.SCORE_KEYS, "sentences"))[1], "issues")
    rows = distill.training_records(found, diagnoses.diagnose(found, "doc_id"), "doc_id")
    wide = [F.coalesce(F.col(kind)[k], F.lit(0.0)).alias(f"{kind}_{k}") for kind, keys in distill.KINDS.items() for k in keys]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("doc_id", *wide, total("sentence_complexities").alias("complexity"), total("cohesion_pairs").alias("cohesion")))


def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features where every third document lacks the morphology and every fifth the syntax."""
    docs = analysed(spark, sf_dir).withColumn("has_m", F.pmod("doc_id", F.lit(3)) != 0).withColumn("has_s", F.pmod("doc_id", F.lit(5)) != 0)
    rows = features.document_features(docs, "doc_id", has_morphology="has_m", has_syntax="has_s")
    return rounded(scoring.with_scores(rows).select("doc_id", "verb_ratio", "binyan_entropy", "avg_sentence_length", "clause_type_entropy", "type_token_ratio", *C.SCORE_KEYS))


def synthetic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence metrics of records without a parse: words for tokens and lemmas, one depth for all sentences."""
    rows = read(spark, sf_dir, "training_records").where("text is not null").withColumn("depth", F.lit(4.0))
    out = frames.synthetic_metrics(rows, "text", "depth").select("record_id", F.posexplode("m").alias("place", "x"))
    return out.select("record_id", F.col("place").cast("long").alias("place"), F.col("x.n").cast("long").alias("n"), F.size("x.lemmas").cast("long").alias("kinds"), F.col("x.depth").alias("depth"))


def intervention_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnoses.interventions(_diagnoses(spark, sf_dir), "doc_id")
    return rounded(rows.withColumn("focus_features", F.array_join("focus_features", ",")).drop("rule_order", "actions", "exercises"))


def analyze_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staged(_diagnoses(spark, sf_dir), "diagnoses")
    shown = views.shown_diagnoses(found, "doc_id")
    kept = views.shown_interventions(diagnoses.interventions(found, "doc_id"), shown, "doc_id")
    return rounded(kept.select("doc_id", "diagnosis", "intervention", "priority", F.col("place").cast("long").alias("place"), views.band(F.col("priority")).alias("band")))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.quality_gate(read(spark, sf_dir, "documents")).select("doc_id", F.coalesce("reason", F.lit("passed")).alias("reason"))


def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.rejections(prep.quality_gate(read(spark, sf_dir, "documents")))


def text_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return rounded(d.select("doc_id", T.sentence_marks(t).cast("long").alias("marks"), T.script_ratio(t).alias("hebrew"), T.repetition_ratio(t).alias("repetition"), T.link_ratio(t).alias("links")))


def fixed_size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return prep.fixed_size_groups(lines, 20, "doc_id", "line_no").select("doc", "n_lines", F.md5(F.col("text")).alias("digest"))


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.summary_stats(_flat(spark, sf_dir)))


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.outliers(_flat(spark, sf_dir)))


def range_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.range_fitness(_flat(spark, sf_dir)))


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.null_counts(_flat(spark, sf_dir))


def _wide_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _flat(spark, sf_dir).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return valid.groupBy("doc_id").pivot("feature", C.FEATURES).agg(F.max("value"))


def layer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.layer_health(_wide_flat(spark, sf_dir), "doc_id"))


def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that go with sentence length and type-token ratio, over documents."""
    targets = ["avg_sentence_length", "type_token_ratio"]
    others = [f for f in C.FEATURES if f not in targets]
    return rounded(reports.feature_drivers(_wide_flat(spark, sf_dir), targets, others, least=0.05).withColumn("place", F.col("place").cast("long")))


def _finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "scores")
    return rows.select("record_id", "scored_at", "loaded_at", *(F.when(~F.isnan(k), F.col(k)).alias(k) for k in C.SCORE_KEYS))


def score_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.score_correlations(_finite_scores(spark, sf_dir)))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(read(spark, sf_dir, "scores"), "difficulty")


def revision_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _finite_scores(spark, sf_dir).distinct()
    found = views.score_changes(rows, "record_id", "scored_at", "loaded_at", *C.SCORE_KEYS)
    return rounded(found.withColumn("revision", F.col("revision").cast("long")))


def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _finite_scores(spark, sf_dir).where("difficulty is not null")
    return rows.groupBy(views.band(F.col("difficulty")).alias("band"), views.highlight(F.col("difficulty")).alias("highlight")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distill.label_stats(read(spark, sf_dir, "training_records"), "record_id"))


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence labels of each document as they go into training records."""
    wide, found = _issues(spark, sf_dir)
    rows = distill.sentence_labels(issues.issue_rows(found, "doc_id"), wide.select("doc_id", F.size("m").alias("n")), "doc_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("doc_id", F.size("sentence_complexities").cast("long").alias("sentences"), total("sentence_complexities").alias("complexity"), F.size("cohesion_pairs").cast("long").alias("pairs"), total("cohesion_pairs").alias("cohesion")))


def trained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "training_records").where("text is not null")
    fitted = distill.trained_labels(records, F.size(T.sentences(F.col("text"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(
        fitted.select(
            "record_id", F.size("sentence_complexities").cast("long").alias("sentences"), total("sentence_complexities").alias("complexity"), F.size("cohesion_pairs").cast("long").alias("pairs"), total("cohesion_pairs").alias("cohesion"), total(F.map_values("issues")).alias("issue_sum")
        )
    )


def _guess(place: Column) -> Column:
    """A stand-in prediction that any engine computes alike."""
    return F.pmod(F.col("record_id") * (place + 3), F.lit(97)) / 97.0


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [(kind, k) for kind, keys in distill.KINDS.items() for k in keys]
    places = F.create_map(*(c for i, (kind, k) in enumerate(order) for c in (F.lit(f"{kind}/{k}"), F.lit(i))))
    rows = distill.long_labels(read(spark, sf_dir, "training_records"), "record_id")
    return rows.select("record_id", "kind", "key", F.col("value").alias("label"), _guess(F.element_at(places, F.concat_ws("/", "kind", "key"))).alias("predicted"))


def f1_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distill.f1_per_type(label_pairs(spark, sf_dir).where("kind <> 'scores'")))


def rmse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distill.rmse(label_pairs(spark, sf_dir).where("kind = 'scores'")))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distill.spearman(label_pairs(spark, sf_dir).where("kind <> 'scores'"), "record_id"))


def multitask_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distill.losses(label_pairs(spark, sf_dir)))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.disagreements(label_pairs(spark, sf_dir), "record_id")
    return rows.groupBy("kind", "key").agg(F.count_if("differs").alias("differing"), F.count(F.lit(1)).alias("n"))


def disagreement_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that any key disagrees on, with the number of such keys and their own labels."""
    cases = distill.disagreement_cases(distill.disagreements(label_pairs(spark, sf_dir), "record_id"), "record_id")
    labels = read(spark, sf_dir, "training_records").select("record_id", "scores")
    return rounded(cases.join(labels, "record_id").select("record_id", "keys", distill.value("scores", "difficulty").alias("difficulty")))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of predictions in one table: error of the scores, F1 and rank correlation of the others."""
    return rounded(distill.evaluation(label_pairs(spark, sf_dir), "record_id"))


def named_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.named_predictions(read(spark, sf_dir, "training_records").where("issues is not null and sentence_complexities is not null and cohesion_pairs is not null"))
    return rounded(rows.select("record_id", F.size("sentence_list").cast("long").alias("sentences"), F.size("pair_list").cast("long").alias("pairs"), F.try_element_at("named_issues", F.lit("sentence_complexity")).alias("complexity"), F.try_element_at("named_issues", F.lit("weak_cohesion")).alias("cohesion")))


def skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents 101 to 300 in the order of their ids, numbered."""
    return prep.skip_take(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", skip=100, take=200)


def mapped_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.punctuation_mapped(t)).alias("digest"), F.md5(T.parser_input(t)).alias("parser_digest"))


def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "training_records").select("record_id", "text", "split")
    merged = distill.merged_last_wins(rows.where("split = 'train'"), rows.where("split <> 'train'"), "text", "record_id")
    return merged.select(F.md5(F.col("text")).alias("digest"), "record_id", "added")


def hybrid_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "training_records").select("record_id", "diagnoses")
    lowered = rows.withColumn("diagnoses", F.transform_values("diagnoses", lambda _, v: v / 2))
    found = distill.routed(rows, lowered, "record_id", 0.2)
    return rounded(found.select("record_id", "confidence", "origin", distill.value("diagnoses", "low_cohesion").alias("low_cohesion")))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.split_exact(read(spark, sf_dir, "training_records").select("record_id"), "record_id", 0.1, 42)


def embedding_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline of the similarity of neighbouring vectors with one label."""
    vectors = read(spark, sf_dir, "embeddings")
    return rounded(baseline.feature_stats(baseline.similarity_stats(vectors, "label", "vec_id", "embedding")), 5)


def sentence_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.annotated_sentences(read(spark, sf_dir, "training_records"), "record_id", "text", "sentence_complexities")
    out = rows.select("record_id", F.col("index").cast("long").alias("index"), F.md5(F.col("sentence")).alias("digest"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "complexity", "highlight")
    return rounded(out)


def cohesion_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.cohesion_gaps(read(spark, sf_dir, "training_records"), "record_id", "text", "cohesion_pairs")
    return rounded(rows.select("record_id", F.col("index").cast("long").alias("index"), "severity", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end")))


def resumable_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.unfinished(read(spark, sf_dir, "training_records").select("record_id", "source"), read(spark, sf_dir, "analysis_inputs"), "record_id")


def share_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = read(spark, sf_dir, "example_texts")
    return rows.select("id", F.md5(T.share_code(t)).alias("digest"), (T.share_text(T.share_code(t)) == t).alias("same"), T.truncated(t, 120).alias("short"))


def token_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each prefix and suffix occurs among the tokens of the corpus."""
    toks = read(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return toks.groupBy(T.prefix(F.col("t")).alias("prefix"), T.suffix(F.col("t")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    groups = {f"{name}_features": _group(name) for name in C.FEATURE_GROUPS}
    plain = (
        token_counts, token_affixes, binyan_distribution, freq_dict, rare_word_ratio, feature_stats, feature_stats_flat, feature_stats_merged, composite_scores,
        normalized_features, issue_table, issue_evidence, issue_sentences, group_scores, ranked_issues_topk, issue_vector, diagnosis_table, diagnosis_support, diagnosis_vector, intervention_table, derived_interventions, analyze_view, training_export, missing_layers, synthetic_metrics, quality_gate,
        rejection_histogram, text_ratios, fixed_size_groups, summary_stats, iqr_outliers, range_fitness, null_counts, layer_health, feature_correlations,
        score_correlations, score_histogram, revision_deltas, severity_bands, label_stats, export_records, trained_labels, f1_per_type, rmse_scores, spearman,
        multitask_loss, disagreements, disagreement_cases, evaluation, named_predictions, skip_take, mapped_punctuation, merge_last_wins, hybrid_routing, train_val_split, embedding_cohesion, sentence_annotations, cohesion_gaps,
        resumable_antijoin, share_url,
    )
    return groups | {f.__name__: f for f in plain}
