"""Texts that no learned language claims go; clean ones stay."""

import base64
import random

from barloom.llm import language
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Быстрая коричневая лиса перепрыгивает через ленивую собаку и убегает далеко в лес, где живёт старый серый волк.",
    "敏捷的棕色狐狸跳过了懒狗,然后跑进了森林深处,那里住着一只老狼。今天的天气很好。",
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει μακριά.",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee kauas metsään, jossa vanha harmaa susi asuu.",
    base64.b64encode(random.Random(0).randbytes(150)).decode(),
]


def test_foreign_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    held = docs.where("text rlike '[a-zA-Z]{3}'").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    other = spark.createDataFrame([(-1 - k, t, "xx") for k, t in enumerate(FOREIGN)], docs.schema)
    left = {r["doc_id"] for r in language.accepted(held.union(other), model).select("doc_id").collect()}
    clean = {r["doc_id"] for r in held.select("doc_id").collect()}
    assert len(clean) > 200
    assert not [i for i in left if i < 0]
    assert left >= clean
