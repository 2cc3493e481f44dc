"""Result documents read back: single ones, and folders of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.operators import figures
from tessarion.operators.table import write_text
from tessarion.plans.documents import CIRCLE_KINDS, circle_of


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, document, text) of the JSON files of a folder, by name; the kind is read from the text."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return files.select("name", F.get_json_object("value", "$.document").alias("document"), F.col("value").alias("text")).orderBy("name")


def circles(docs: DataFrame) -> DataFrame:
    """Those that hold one circle."""
    return docs.where(F.col("document").isin(*CIRCLE_KINDS))


def build_gallery(spark: SparkSession, folder: str, output: str, attribution: dict[str, str]) -> list[str]:
    """Figures, documents and an index in ``output``, wherever Spark can write, each put in place by a rename and the index last; nothing is
    written if any document is refused."""
    made = []
    for r in circles(documents(spark, folder)).collect():  # a gallery is a page of figures
        circle = circle_of(json.loads(r["text"]))
        made.append((r["name"], r["text"], circle, figures.render_svg(spark, circle, attribution[circle.dataset])))
    for name, text, _, svg in made:
        for kind, content in (("json", text), ("svg", svg)):
            write_text(spark, f"{output}/{name}.{kind}", content)
    write_text(spark, f"{output}/index.html", figures.gallery_page([(n, c) for n, _, c, _ in made]))
    return [n for n, *_ in made]
