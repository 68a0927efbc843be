"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, embeddings, extract, language, lines, manifest, minhash, mixing, quality, secrets, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: The rules of the URL filter, as its contract lists them.
CONTRACT_RULES: list[urls.Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The rules that the SQL twin is made of. The words of its third and fourth are not the contract's; the SQL is left as it is.
URL_RULES: list[urls.Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The list of blocked URLs, by rule: numbered pages of these hosts under the languages of the site. Many are on no page.
LISTED_LABELS = ("spam-farm", "adult-x", "casino-win")
LISTED_ENDS = ("com", "net", "org")
LISTED_LANGUAGES = ("en", "de", "fr", "es")
LISTED_NUMBERS = 10_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """url_key: canonical URLs <label>.example.<end>/<language>/<number>."""
    parts = [F.explode(F.array(*map(F.lit, x))) for x in (LISTED_LABELS, LISTED_ENDS, LISTED_LANGUAGES)]
    rows = spark.range(LISTED_NUMBERS).select("id", parts[0].alias("label")).select("*", parts[1].alias("end")).select("*", parts[2].alias("lang"))
    return rows.select(F.format_string("%s.example.%s/%s/%d", "label", "end", "lang", "id").alias("url_key"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.judge(pages, CONTRACT_RULES, listed_urls(spark))


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs.where(_fold(5) != 0), _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(_fold(4) != 2))
    return language.identify(docs, model).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, words=secrets.dictionary(docs))
    rank = {k: i for i, k in enumerate(secrets.KINDS)}

    def key(s: Column) -> Column:
        order = F.lit(len(rank))
        for k, i in rank.items():
            order = F.when(s["kind"] == k, i).otherwise(order)
        return F.struct(s["start"].alias("start"), order.alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))

    every = F.sort_array(F.transform(F.concat("base", "added"), key))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans")
    )


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


def source_weights() -> dict[str, int]:
    """Parts of the twenty sources: 1 to 4 in turn, 50 in all."""
    return {f"src{k}": 1 + k % 4 for k in range(20)}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, source_weights())


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.to_turns(chat.records_of_rows(rows.select("conv_id", "turn", "role", "text").union(more))))
    back = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, first_doc, first_line: the lines to remove, of all documents."""
    found = lines.repeated_lines(_read(spark, sf_dir, "documents"), short=True)
    return found.select("doc_id", "line_no", "first_doc", "first_line")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_read(spark, sf_dir, "documents")).drop("proof")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(_read(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_decontamination, op2_url_filter, op3_quality, op4_language_id, op5_secrets,
        op6_minhash_dedup, op7_mixing, op8_chat_format, op9_line_dedup, op10_embedding_dedup,
        op11_merkle_manifest, op12_html_extraction, op13_filter_audit,
    ]
    return {f.__name__: f for f in own}
