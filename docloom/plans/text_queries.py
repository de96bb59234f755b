"""Queries over texts, names and boundaries and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.chunking import chunk_documents
from docloom.functions.text import extension, family, normalise_space, preview, safe_filename, split_sentences, stem, unique_name, word_count
from docloom.operators import semantic
from docloom.plans.corpora import FILES_SQL, LETTERS_SQL, files, letter_model, letter_weight, table
from docloom.plans.jobs import index_directory
from docloom.sources.chunk_table import stored_chunks
from docloom.sources.files import html_text_column
from docloom.sources.scratch import new_path
from docloom.streaming.ingest import start_upload_stream

Frame = DataFrame


def normalize_sentences(spark: SparkSession, sf_dir: str) -> Frame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_sentences(normalise_space("text"))).alias("i", "sentence"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("i"), F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


def word_counts(spark: SparkSession, sf_dir: str) -> Frame:
    return table(spark, sf_dir, "documents").select("doc_id", word_count("text").cast("bigint").alias("n_words"))


def previews(spark: SparkSession, sf_dir: str) -> Frame:
    return table(spark, sf_dir, "documents").select("doc_id", preview("text").alias("preview"), F.length(preview("text", 500)).cast("bigint").alias("n_snippet"))


def safe_names(spark: SparkSession, sf_dir: str) -> Frame:
    """Page addresses as file names."""
    return table(spark, sf_dir, "pages").select("page_id", safe_filename(F.concat("url", F.lit("/ The page..")).cast("string")).alias("a"), safe_filename("url").alias("b"))


def upload_names(spark: SparkSession, sf_dir: str) -> Frame:
    """Unique names and loader families of files."""
    rows = files(spark, sf_dir)
    name = safe_filename("source")
    ext = extension("source")
    return rows.select("doc_id", unique_name(name, "source", "content_hash").alias("unique_name"), stem(name).alias("stem"), ext.alias("ext"), family(ext).alias("family"))


def chunk_loose(spark: SparkSession, sf_dir: str) -> Frame:
    chunks = chunk_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def chunk_bounded(spark: SparkSession, sf_dir: str) -> Frame:
    chunks = chunk_documents(table(spark, sf_dir, "documents"), ["doc_id"], bounded=True)
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def sentence_words(spark: SparkSession, sf_dir: str) -> Frame:
    return semantic.sentence_rows(table(spark, sf_dir, "documents"), "doc_id")


def _lists(spark: SparkSession, sf_dir: str) -> Frame:
    return semantic.sentence_lists(table(spark, sf_dir, "documents"), "doc_id")


def pack_blocks(spark: SparkSession, sf_dir: str) -> Frame:
    return semantic.block_rows(_lists(spark, sf_dir), "doc_id", target=150)


def boundary_requests(spark: SparkSession, sf_dir: str) -> Frame:
    out = semantic.boundary_requests(_lists(spark, sf_dir), "doc_id", target=150)
    return out.select("doc_id", "block", "offset", "n", F.md5(F.col("numbered").cast("binary")).alias("numbered_md5"))


def _threes(lists: Frame) -> Frame:
    """A boundary for every three sentences of a document."""
    last = F.size("words") - 1
    starts = lists.select("doc_id", last.alias("last"), F.posexplode(F.sequence(F.lit(0), last, F.lit(3))).alias("pos", "start"))
    return starts.select("doc_id", F.lit(0).alias("block"), "pos", "start", F.least(F.col("start") + 2, F.col("last")).alias("end"), F.concat(F.lit("h"), F.col("pos").cast("string")).alias("header"))


def merge_small_chunks(spark: SparkSession, sf_dir: str) -> Frame:
    lists = _lists(spark, sf_dir)
    merged = semantic.merged_boundaries(semantic.boundary_lists(_threes(lists), lists, "doc_id"), "doc_id", least=40)
    return semantic.boundary_texts(merged, "doc_id").select("doc_id", F.col("place").alias("pos"), "start", "end", "header")


def _halves(requests: Frame) -> Frame:
    """Replies that split every block in two; every third cannot be read."""
    half = F.floor((F.col("n") - 1) / 2).cast("int")
    good = F.format_string('```json\n{"chunks": [{"start_sentence": 0, "end_sentence": %d, "header": "A"}, {"start_sentence": %d, "end_sentence": %d, "header": "B"}]}\n```', half, half + 1, F.col("n") - 1)
    return requests.select("doc_id", "block", F.when(F.col("block") % 3 == 2, "sorry").otherwise(good).alias("response"))


def boundary_chunks(spark: SparkSession, sf_dir: str) -> Frame:
    """Chunks from replies that split every block in two; every third reply cannot be read."""
    lists = _lists(spark, sf_dir)
    requests = semantic.boundary_requests(lists, "doc_id", target=150)
    found = semantic.parse_boundaries(requests, _halves(requests), "doc_id")
    out = semantic.boundary_texts(semantic.boundary_lists(found, lists, "doc_id"), "doc_id")
    text = semantic.embed_text(F.col("header"), F.col("chunk"))
    return out.select("doc_id", (F.col("block") * 10 + F.col("pos")).alias("pos"), "header", F.md5(text.cast("binary")).alias("text_md5"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> Frame:
    """The whole way with the replies of ``boundary_chunks``, small chunks merged into their followers."""
    docs = table(spark, sf_dir, "documents")
    requests = semantic.boundary_requests(_lists(spark, sf_dir), "doc_id", target=150)
    found = semantic.chunk_semantically(docs, _halves(requests), "doc_id", target=150, least=50)
    return found.select("doc_id", "chunk_index", "header", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def html_text(spark: SparkSession, sf_dir: str) -> Frame:
    return table(spark, sf_dir, "pages").select("page_id", html_text_column(F.col("html")).alias("text"))


def _write_files(spark: SparkSession, sf_dir: str, where: str) -> None:
    """Documents as text files, ten in each, a thousand files in a folder: each task writes its own."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("i"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("d"))
    lines = F.transform(F.array_sort(F.collect_list("d")), lambda d: F.concat(d["text"], F.lit("\n")))
    files = docs.groupBy("i").agg(F.array_join(lines, "").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(where)
        made = set()
        for frame in batches:
            for i, text in zip(frame["i"], frame["text"], strict=True):
                folder = f"{root}/{i // 1000}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/f{i}.txt", compression=None) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    files.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def directory_ingest(spark: SparkSession, sf_dir: str) -> Frame:
    """Text files brought into an empty chunk table, and again, when nothing is new: chunks, characters and vectors by the hash of the file."""
    base = new_path(spark, "directory")
    _write_files(spark, sf_dir, f"{base}/files")
    for _ in range(2):
        done = index_directory(spark, f"{base}/files", f"{base}/table", f"{base}/cache", letter_model, 0)
    status = done.classified.groupBy("content_hash").agg(F.min("status").alias("status"))
    chunks = done.chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.sum(letter_weight("embedding")).alias("weight"))
    return chunks.join(status, "content_hash")


def stream_ingest(spark: SparkSession, sf_dir: str) -> Frame:
    """Text files that an upload stream indexes: chunks, characters and vectors by the hash of the file."""
    base = new_path(spark, "stream")
    _write_files(spark, sf_dir, f"{base}/landing")
    start_upload_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", 0, once=True, model=letter_model).awaitTermination()
    chunks = stored_chunks(spark, f"{base}/table", 0).groupBy("content_hash")
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.sum(letter_weight("embedding")).alias("weight"))


def sentences_of(text: str) -> str:
    """The sentences of normalised text in SQL."""
    return rf"string_split(regexp_replace(trim(regexp_replace({text}, '\s+', ' ', 'g'), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def loose_sql(rows: str) -> str:
    """``chunk`` (doc_id, i, k, chunk): the loose chunks of ``rows`` (doc_id, text), ordered by i and k."""
    return f"""norm AS (SELECT doc_id, {sentences_of("text")} AS a FROM {rows}),
fold AS (
  SELECT doc_id, a, 0 AS i, '' AS cur, NULL::VARCHAR AS done FROM norm
  UNION ALL
  SELECT doc_id, a, i + 1,
         CASE WHEN cur <> '' AND length(cur) + length(a[i + 1]) > 500 THEN right(cur, 100) ELSE cur END || ' ' || a[i + 1],
         CASE WHEN cur <> '' AND length(cur) + length(a[i + 1]) > 500 THEN trim(cur, ' ') END
  FROM fold WHERE i < len(a)),
chunk AS (SELECT doc_id, i, 0 AS k, done AS chunk FROM fold WHERE done IS NOT NULL
          UNION ALL SELECT doc_id, i, 1, trim(cur, ' ') FROM fold WHERE i = len(a) AND trim(cur, ' ') <> '')"""


def bounded_sql(rows: str) -> str:
    """``bchunk`` (doc_id, i, k, chunk): the bounded chunks of ``rows``: long sentences in segments of whole words, longer words in slices, pieces packed."""
    return f"""bsent AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, {sentences_of("text")} AS a FROM {rows})),
bword AS (SELECT doc_id, n, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS j FROM bsent WHERE length(s) > 500),
bitem AS (SELECT doc_id, n, j, 0 AS h, w AS t, FALSE AS slice FROM bword WHERE length(w) <= 500
          UNION ALL SELECT doc_id, n, j, h, substr(w, h * 500 + 1, 500), TRUE FROM (SELECT *, unnest(range(0, (length(w) + 499) // 500)) AS h FROM bword WHERE length(w) > 500)),
blist AS (SELECT doc_id, n, list({{'t': t, 'slice': slice}} ORDER BY j, h) AS ws FROM bitem GROUP BY doc_id, n),
bseg AS (
  SELECT doc_id, n, ws, 0 AS i, '' AS seg, NULL::VARCHAR AS d1, NULL::VARCHAR AS d2 FROM blist
  UNION ALL
  SELECT doc_id, n, ws, i + 1, CASE WHEN x.slice THEN '' WHEN seg = '' OR length(seg) + 1 + length(x.t) > 500 THEN x.t ELSE seg || ' ' || x.t END,
         CASE WHEN seg <> '' AND (x.slice OR length(seg) + 1 + length(x.t) > 500) THEN seg END, CASE WHEN x.slice THEN x.t END
  FROM (SELECT *, ws[i + 1] AS x FROM bseg WHERE i < len(ws))),
bpiece AS (SELECT doc_id, n, 0 AS i, 0 AS k, s AS piece FROM bsent WHERE length(s) <= 500
           UNION ALL SELECT doc_id, n, i, 0, d1 FROM bseg WHERE d1 IS NOT NULL UNION ALL SELECT doc_id, n, i, 1, d2 FROM bseg WHERE d2 IS NOT NULL
           UNION ALL SELECT doc_id, n, i, 2, seg FROM bseg WHERE i = len(ws)),
bpieces AS (SELECT doc_id, list(piece ORDER BY n, i, k) AS p FROM bpiece GROUP BY doc_id),
bfold AS (
  SELECT doc_id, p, 0 AS i, '' AS held, NULL::VARCHAR AS done FROM bpieces
  UNION ALL
  SELECT doc_id, p, i + 1,
         trim(CASE WHEN NOT past THEN held || ' ' || x WHEN length(x) >= 499 THEN left(x, 500) ELSE right(right(held, 100), 499 - length(x)) || ' ' || x END, ' '), CASE WHEN past THEN held END
  FROM (SELECT *, p[i + 1] AS x, held <> '' AND length(held) + length(p[i + 1]) + 1 > 500 AS past FROM bfold WHERE i < len(p))),
bchunk AS (SELECT doc_id, i, 0 AS k, done AS chunk FROM bfold WHERE done IS NOT NULL UNION ALL SELECT doc_id, i, 1, held FROM bfold WHERE i = len(p) AND held <> '')"""


#: The files of ``_write_files`` and their chunks.
ARRIVED_SQL = f"arrived AS (SELECT doc_id // 10 AS doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL), {loose_sql('arrived')}"
LOOSE_SQL = f"WITH RECURSIVE {loose_sql('documents')}"
#: Sentences of the raw text, trimmed, without empty ones, and their words.
SENTENCES_SQL = r"""raw AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS a FROM documents),
sent AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS i FROM raw),
counted AS (SELECT *, len(regexp_extract_all(sentence, '\S+')) AS words FROM sent),
lists AS (SELECT doc_id, list(words ORDER BY i) AS w FROM counted GROUP BY doc_id),
pack AS (
  SELECT doc_id, w, 0 AS i, 0 AS start, 0 AS total, NULL::INT AS first, NULL::INT AS last FROM lists
  UNION ALL
  SELECT doc_id, w, i + 1, CASE WHEN cut THEN i ELSE start END, CASE WHEN cut THEN 0 ELSE total END + w[i + 1], CASE WHEN cut THEN start END, CASE WHEN cut THEN i - 1 END
  FROM (SELECT *, total > 0 AND total + w[i + 1] > 150 AS cut FROM pack WHERE i < len(w))),
ranges AS (SELECT doc_id, first, last FROM pack WHERE first IS NOT NULL UNION ALL SELECT doc_id, start, i - 1 FROM pack WHERE i = len(w)),
blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS block, first::INT AS first, last::INT AS last FROM ranges)"""
#: Boundaries as the replies of ``_halves`` give them.
HALVES_SQL = """b AS (SELECT doc_id, block, first, last, first + (last - first) // 2 AS mid FROM blocks),
p AS (SELECT doc_id, block * 10 AS pos, first AS s, last AS e, 'Content section' AS header FROM b WHERE block % 3 = 2
      UNION ALL SELECT doc_id, block * 10, first, mid, 'A' FROM b WHERE block % 3 <> 2 UNION ALL SELECT doc_id, block * 10 + 1, mid + 1, last, 'B' FROM b WHERE block % 3 <> 2)"""
MERGE_SQL = (
    f"WITH RECURSIVE {SENTENCES_SQL}"
    + """,
three AS (SELECT doc_id, w, unnest(range(0, len(w), 3)) AS s FROM lists),
bounds AS (SELECT doc_id, any_value(w) AS w, list(s ORDER BY s) AS ss FROM three GROUP BY doc_id),
merge AS (
  SELECT doc_id, w, ss, 1 AS k, 0 AS start, least(2, len(w) - 1) AS stop, 'h0' AS header, NULL::STRUCT(s BIGINT, e BIGINT, h VARCHAR) AS done FROM bounds
  UNION ALL
  SELECT doc_id, w, ss, k + 1, CASE WHEN small THEN start ELSE ss[k + 1] END, least(ss[k + 1] + 2, len(w) - 1), CASE WHEN small THEN header || '; ' ELSE '' END || 'h' || k,
         CASE WHEN NOT small THEN {'s': start, 'e': stop, 'h': header} END
  FROM (SELECT *, list_sum(w[start + 1 : stop + 1]) < 40 AS small FROM merge WHERE k < len(ss))),
rows AS (SELECT doc_id, done.s AS s, done.e AS e, done.h AS h FROM merge WHERE done IS NOT NULL UNION ALL SELECT doc_id, start, stop, header FROM merge WHERE k = len(ss))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS pos, s::INT AS start, e::INT AS "end", h AS header FROM rows"""
)
SAFE = r"regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({}, '^.*/', ''), '[^\p{{L}}\p{{M}}\p{{N}}_\s.\-]', '', 'g'), ' ', '_'), '\.+', '.', 'g'), '^[. ]+|[. ]+$', '', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_sentences, word_counts, previews, safe_names, upload_names, chunk_loose, chunk_bounded, sentence_words, pack_blocks, boundary_requests, merge_small_chunks, boundary_chunks, semantic_chunks,
        html_text, directory_ingest, stream_ingest,
    )
}
SQL = {
    "normalize_sentences": f"WITH norm AS (SELECT doc_id, {sentences_of('text')} AS a FROM documents) SELECT doc_id, unnest(list_transform(a, lambda s: md5(s))) AS sentence_md5, generate_subscripts(a, 1) - 1 AS i FROM norm",
    "word_counts": r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words FROM documents",
    "previews": "SELECT doc_id, left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview, CASE WHEN length(text) > 500 THEN 503 ELSE length(text) END::BIGINT AS n_snippet FROM documents",
    "safe_names": f"SELECT page_id, {SAFE.format(chr(39) + ' The page..' + chr(39))} AS a, {SAFE.format('url')} AS b FROM pages",
    "upload_names": f"""WITH {FILES_SQL} SELECT doc_id, doc_id || '_' || left(sha256(source || content_hash), 8) || coalesce(file_type, '') AS unique_name, doc_id::VARCHAR AS stem, coalesce(file_type, '') AS ext,
       CASE file_type WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' WHEN '.docx' THEN 'document' END AS family FROM files""",
    "chunk_loose": f"{LOOSE_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk_index, md5(chunk) AS chunk_md5 FROM chunk",
    "sentence_words": f"WITH RECURSIVE {SENTENCES_SQL} SELECT doc_id, i::INT AS i, sentence, words::INT AS words FROM counted",
    "pack_blocks": f"WITH RECURSIVE {SENTENCES_SQL} SELECT doc_id, block, first, last FROM blocks",
    "boundary_requests": f"""WITH RECURSIVE {SENTENCES_SQL} SELECT doc_id, block, any_value(first) AS "offset", count(*)::INT AS n, md5(string_agg('[' || (i - first) || '] ' || sentence, chr(10) ORDER BY i)) AS numbered_md5
FROM blocks JOIN counted USING (doc_id) WHERE i BETWEEN first AND last GROUP BY doc_id, block""",
    "merge_small_chunks": MERGE_SQL,
    "boundary_chunks": f"""WITH RECURSIVE {SENTENCES_SQL}, {HALVES_SQL}
SELECT doc_id, pos, header, md5(header || chr(10) || chr(10) || coalesce(string_agg(sentence, ' ' ORDER BY i), '')) AS text_md5 FROM p LEFT JOIN counted USING (doc_id) WHERE i BETWEEN s AND e GROUP BY doc_id, pos, header
UNION ALL SELECT doc_id, pos, header, md5(header || chr(10) || chr(10)) FROM p WHERE s > e""",
    "chunk_bounded": f"WITH RECURSIVE {bounded_sql('documents')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk_index, length(chunk)::INT AS n_chars, md5(chunk) AS chunk_md5 FROM bchunk",
    "directory_ingest": f"""WITH RECURSIVE {ARRIVED_SQL}
SELECT left(sha256(text), 16) AS content_hash, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars, sum({LETTERS_SQL.format("chunk")})::BIGINT AS weight, 'unchanged' AS status FROM chunk JOIN arrived USING (doc_id) GROUP BY content_hash""",
    "stream_ingest": f"""WITH RECURSIVE {ARRIVED_SQL}
SELECT left(sha256(text), 16) AS content_hash, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars, sum({LETTERS_SQL.format("chunk")})::BIGINT AS weight FROM chunk JOIN arrived USING (doc_id) GROUP BY content_hash""",
    "semantic_chunks": f"""WITH RECURSIVE {SENTENCES_SQL}, {HALVES_SQL},
bounds AS (SELECT doc_id, any_value(w) AS w, list({{'s': s, 'e': e, 'h': header}} ORDER BY pos) AS bs FROM p JOIN lists USING (doc_id) GROUP BY doc_id),
merge AS (
  SELECT doc_id, w, bs, 1 AS k, bs[1].s AS start, bs[1].e AS stop, bs[1].h AS header, NULL::STRUCT(s BIGINT, e BIGINT, h VARCHAR) AS done FROM bounds
  UNION ALL
  SELECT doc_id, w, bs, k + 1, CASE WHEN small THEN start ELSE bs[k + 1].s END, bs[k + 1].e, CASE WHEN small THEN header || '; ' ELSE '' END || bs[k + 1].h, CASE WHEN NOT small THEN {{'s': start, 'e': stop, 'h': header}} END
  FROM (SELECT *, coalesce(list_sum(w[start + 1 : stop + 1]), 0) < 50 AS small FROM merge WHERE k < len(bs))),
kept AS (SELECT doc_id, k, done.s AS s, done.e AS e, done.h AS header FROM merge WHERE done IS NOT NULL UNION ALL SELECT doc_id, k + 1, start, stop, header FROM merge WHERE k = len(bs)),
placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index FROM kept)
SELECT doc_id, chunk_index, header, md5(coalesce(string_agg(sentence, ' ' ORDER BY i) FILTER (i BETWEEN s AND e), '')) AS chunk_md5
FROM placed LEFT JOIN counted USING (doc_id) GROUP BY doc_id, chunk_index, header, s, e""",
}
