"""The pipeline's language stage drops unlearned languages and noise, and keeps clean and mixed texts."""

import random

from logloom.llm import langid
from logloom.ship import ship

SF = "/root/testdata/sf0.001"
FOREIGN = ["Η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο", "Съешь же ещё этих мягких французских булок да выпей чаю", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään jossa sen perhe asuu", "日本語の文章はここにありますとても長いです"]


def test_unlearned_languages_and_noise_go(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)), "qzx vkj wqp zzxq jjkv " * 10, "x 123 456 !!", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ " * 8]
    by = {lang: docs.where(f"lang = '{lang}' and n_chars > 1000").orderBy("doc_id").first()["text"] for lang in ("de", "es")}
    odd = [t * 3 for t in FOREIGN] + noise
    mixed = [by["de"][:1000] + " " + by["es"][:1000]]
    rows = [(900_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd + mixed)]
    kept = {r["doc_id"] for r in langid.identified(docs.union(spark.createDataFrame(rows, docs.schema)), langid.fit(docs)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {900_000 + len(odd)}


def test_a_language_left_out_goes(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("lang <> 'es'"))
    kept = langid.identified(docs, model).groupBy("lang").count().collect()
    every = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    kept = {r["lang"]: r["count"] for r in kept}
    assert all(kept[x] == every[x] for x in every if x != "es") and kept.get("es", 0) < 0.1 * every["es"]
