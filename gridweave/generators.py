"""Mock contacts, made in parallel and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Ada Ben Cora Dan Eva Finn Gina Hugo Iris Jon Kira Leo Mia Noah Olga Paul Rosa Sam Tara Vera".split()
LAST = "Adams Baker Clark Diaz Evans Fox Gray Hill Ito Jones King Lopez Moore Nash Owens Park Reed Stone Todd Young".split()
SITES = "acorn birch cedar delta ember fjord grove haven inlet juniper".split()


def mock_contacts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of first name, last name, phone, e-mail and website."""
    def pick(words: list[str], salt: str) -> Column:
        at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(words)))
        return F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))

    digits = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("phone")), F.lit(10**10)).cast("string")
    phone = F.regexp_replace(F.lpad(digits, 10, "0"), r"(\d{3})(\d{3})(\d{4})", "$1-$2-$3")
    rows = spark.range(n).select("id", pick(FIRST, "f").alias("f"), pick(LAST, "l").alias("l"), pick(SITES, "s").alias("s"), phone.alias("p"))
    return rows.select(
        F.col("f").alias("First Name"),
        F.col("l").alias("Last Name"),
        F.col("p").alias("Phone Number"),
        F.lower(F.concat("f", F.lit("."), "l", F.lit("@"), "s", F.lit(".example"))).alias("Email"),
        F.concat(F.lit("https://www."), "s", F.lit(".example/")).alias("Website"),
    )
