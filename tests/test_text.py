from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.cache import cache_key


def values(spark, inputs, function):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in sorted(rows.select("i", function(F.col("x"))).collect())]


def test_space_and_sentences(spark):
    assert values(spark, ["  a  b\n\nc ", ""], t.normalise_space) == ["a b c", ""]
    assert values(spark, ["A b. C! D?  e", ""], t.split_sentences) == [["A b.", "C!", "D?", "e"], [""]]
    assert values(spark, [" A. B. ", "", None], t.sentence_tokens) == [["A.", "B."], [], None]
    assert values(spark, ["", "a  b c"], t.word_count) == [0, 3]


def test_previews_count_code_points(spark):
    assert values(spark, ["x" * 200, "😀" * 201], t.preview) == ["x" * 200, "😀" * 200 + "..."]


def test_safe_names(spark):
    names = ["../../etc/my file..v2!.pdf", "...", "a/b/é ñ.TXT", ""]
    assert values(spark, names, t.safe_filename) == ["my_file.v2.pdf", "", "é_ñ.TXT", ""]
    assert values(spark, ["a/b.PDF", "a.b/c", ".hidden", "x.tar.gz", "..a.txt"], t.extension) == [".pdf", "", "", ".gz", ".txt"]
    assert values(spark, [".pdf", ".htm", ".exe", ""], t.family) == ["pdf", "document", None, None]
    assert values(spark, ["my.v2.pdf"], lambda c: t.unique_name(c, F.lit("p"), F.lit("h")))[0][:6] == "my.v2_"


def test_hashes(spark):
    assert values(spark, ["hello"], t.content_hash) == ["2cf24dba5fb0a30e"]
    assert values(spark, ["hello"], lambda c: cache_key("embedding", c)) == ["embedding:2cf24dba5fb0a30e"]


def test_vectors(spark):
    assert values(spark, ["[1.0,2.5]", "x", "[1]"], lambda c: t.vector_from_text(c, 2)) == [[1.0, 2.5], None, None]


def test_files_of_documents_share_folders(spark, sf_dir, tmp_path):
    from docloom.plans.text_queries import _write_files

    _write_files(spark, sf_dir, str(tmp_path / "files"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    tens = {d // 10 for d in docs}
    assert {p.name for p in (tmp_path / "files").iterdir()} == {str(i // 1000) for i in tens}
    for i in tens:
        assert (tmp_path / "files" / str(i // 1000) / f"f{i}.txt").read_bytes().decode() == "".join(docs[d] + "\n" for d in sorted(docs) if d // 10 == i)
