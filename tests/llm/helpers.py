"""Small tables with the cases that every operator must stand: nulls, empty, long, ties, repeats, clashing names."""

from pyspark.sql import DataFrame, SparkSession

WORDS = "the cat sat on a mat and then it ran to the old house near river where nobody ever goes at night".split()


def prose(n: int, salt: int) -> str:
    out = []
    for i in range(n):
        out.append(WORDS[(i * i * 7 + i * salt + salt) % len(WORDS)] + ("." if i % 9 == 8 else ""))
        out.append("\n" if i % 40 == 39 else " ")
    return "".join(out).strip() + "."


def rows() -> list[tuple]:
    base = [(i, prose(20 + 13 * i, i), ["en", "fr", None][i % 3], ["b", "a", None][i % 3]) for i in range(12)]
    return base + [
        (20, None, "en", "a"),
        (21, "", "en", "b"),
        (22, "word", None, None),
        (23, "ÄÖ é 日本語 " * 40, "fr", "a"),
        (24, prose(30_000, 5), "en", "hot"),
        (25, base[3][1], "en", "hot"),
        (26, base[3][1], "en", "hot"),
        (27, "x" * 20_000, "en", "a"),
        (None, "a row without an id that says something.", "en", "a"),
        (3, base[3][1], "en", "a"),
        (3, "another text under the same id.", "en", "a"),
        (28, " \t\n\x0b\x0c\r ", "fr", "b"),
    ]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    """With columns whose names operators use inside."""
    given = rows() if data is None else data
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0, "x", 7, 8) for r in given], "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, node bigint, part int")
    return frame.repartition(3)
