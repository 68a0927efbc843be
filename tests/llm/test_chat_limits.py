"""Large texts, conversations and roles are read back exactly."""

import hashlib

from pyspark.sql import functions as F

from barloom.llm import chat
from barloom.llm.queries import op8_chat_format


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_large_texts_and_roles(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, "user", "x"), (2, 0, "user", "y"), (2, 1, "assistant", "z"), (3, 0, "r]\\\n", "w"), (3, 1, "user", "w")], "conv_id long, turn long, role string, text string"
    )
    big = rows.withColumn("text", F.when(F.col("conv_id") == 2, F.expr("repeat(text, 21000000)")).otherwise(F.col("text")))
    big = big.withColumn("role", F.when(F.col("role").startswith("r]"), F.expr("repeat(role, 20000)")).otherwise(F.col("role")))
    big.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    n = 21_000_000
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == sha("user\n" + "y" * n + "\nassistant\n" + "z" * n + "\n")
    assert got[2]["loss_chars"] == n and got[2]["loss_sha256"] == sha("z" * n)
    assert got[3]["turns_sha256"] == sha("r]\\\n" * 20000 + "\nw\nuser\nw\n") and got[1]["n_turns"] == 1


def test_struct_records_are_read_as_json_ones(spark):
    rows = spark.createDataFrame([(1, "q", "r", "s"), (2, None, "r", None)], "id long, prompt string, completion string, system string")
    for record in ({"prompt", "completion", "id"}, {"prompt", "completion", "system"}):
        as_struct = rows.select(F.col("id").alias("n"), F.struct(*sorted(record)).alias("record"))
        read = chat.to_turns(as_struct).orderBy("n").collect()
        text = as_struct.where("n = 1").withColumn("record", F.to_json("record"))
        assert read[0] == chat.to_turns(text).collect()[0] and read[0]["layout"] == "(prompt,completion)"
        assert [t["text"] for t in read[1]["turns"]] == ["", "r"]
    other = chat.to_turns(rows.select(F.struct("id").alias("record"))).collect()
    assert all(r["layout"] is None and r["turns"] is None for r in other)
