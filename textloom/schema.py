"""Fixed schemas, as DDL: nothing is inferred."""

from __future__ import annotations

FILES = "path string not null, content binary, length long, modificationTime timestamp"
CHUNKS = (
    "id string not null, path string not null, text string not null, vector array<float>, start_line int not null, end_line int not null, "
    "content_hash string not null, chunk_hash string not null, chunk_type string, chunk_name string, chunk_signature string, "
    "chunk_docstring string, chunk_parent string, chunk_tags array<string>, chunk_language string"
)
PIECES = "array<struct<text:string,start_line:int,end_line:int,type:string,name:string,parent:string,signature:string,docstring:string,tags:array<string>>>"
SUMMARY = (
    "struct<functions:array<struct<name:string,start_line:int,end_line:int,complexity:int,nesting:int>>,classes:array<string>,imports:array<string>,"
    "exports:array<string>,total:int,code:int,blank:int,comment:int,decisions:int,cyclomatic:int,max_nesting:int,avg:double,score:int>"
)
EVENTS = "path string, op string, seq long, ts timestamp"
METADATA_VERSION = 1
