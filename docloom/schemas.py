"""Schemas of the stored tables and of the records that models return."""

from __future__ import annotations

USERS = "id bigint, name string, api_key string"
CHUNKS = (
    "id bigint, user_id int, chunk string, header string, embedding array<float>, source string, "
    "chunk_index int, file_type string, content_hash string, file_mtime timestamp_ntz"
)
VECTORS = "digest string, embedding array<float>"
#: Files that wait for texts of pictures or pages, or have an error; ``needs`` lists the pictures, ``text`` is what the file says itself.
PENDING = "user_id int, source string, path string, file_type string, content_hash string, file_mtime timestamp_ntz, text string, needs array<struct<img_idx:int,digest:string>>, error string"
CLOSED = "user_id int, source string, content_hash string"
#: What a model is asked, once for each picture, and what it or the page job answered, by digest of a picture or path of a file.
REQUESTS = "digest string, prompt string, content binary"
REPLIES = "digest string, path string, text string"
CHUNK_COLUMNS = ["user_id", "chunk", "header", "embedding", "source", "chunk_index", "file_type", "content_hash", "file_mtime"]
QUERIES = "query_id bigint, user_id int, question string, embedding array<float>"
BOUNDARY_REPLY = "struct<chunks:array<struct<start_sentence:int,end_sentence:int,header:string>>>"
#: Indices are read as text: one that is no number must not lose the others.
RERANK_REPLY = "struct<indices:array<string>,rejected:boolean>"
