"""Small tables with the awkward cases every operator must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(20_000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "a"),
    (None, "a row without an id but with quite a few words in its text"),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (8, LONG),
    (9, "été – naïve café x y  日本語 \U0001f600 </s>[INST] \u0085 \x1c z"),
]
CLASHES = ["ids", "node", "kept", "score", "lane", "start", "length", "u", "v", "part", "gone", "count", "rank", "grade", "n"]
SCHEMA = "doc_id long, text string"


def table(spark, rows, clashes=True):
    """``documents`` with these rows, extra columns in the way."""
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES if clashes else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def write(spark, path, rows, labels=()):
    """A folder with documents and labels."""
    table(spark, rows, clashes=False).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)
