"""The property graph's two tables and its fixed vocabularies."""

from __future__ import annotations

NODE = "id string, kind string, title string, content string, tags array<string>, level int, embedding array<float>, vitality double, access_count long, success_count long, failure_count long, properties map<string,string>, source string, created_at double, updated_at double"
EDGE = "id string, source_id string, target_id string, kind string, weight double, created_at double"
DOCUMENT = "doc_id string, title string, content string, source string, category string, year int, properties map<string,string>, chunks array<struct<chunk_id:string,doc_id:string,text:string,index:int,page_number:int>>"

#: How far rank flows along an edge of each kind; other kinds take DEFAULT_FLOW.
FLOW = {
    "caused": 1.0,
    "resulted_in": 1.0,
    "depends_on": 0.9,
    "learned_from": 0.8,
    "produced": 0.8,
    "part_of": 0.7,
    "contains": 0.6,
    "related": 0.4,
    "contradicts": 0.2,
    "supersedes": 0.3,
    "is_a": 0.5,
    "invoked": 0.6,
    "followed_by": 0.7,
    "mentions": 0.8,
    "extracted_from": 0.8,
    "next_chunk": 0.3,
}
DEFAULT_FLOW = 0.5
