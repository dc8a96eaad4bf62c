"""Schemas of the graph's tables and of what the extractors emit."""

from __future__ import annotations

NODE_KINDS = ("repo", "package", "file", "class", "function", "method", "doc", "config", "test")
EDGE_KINDS = ("contains", "imports", "calls", "inherits", "implements", "tests")
REPO_STATUSES = ("pending", "cloning", "parsing", "enriching", "indexing", "indexed", "failed")

METRICS = "struct<loc:int,fan_in:int,fan_out:int>"
ANNOTATION = "struct<text:string,kind:string,evidence:array<string>,source:string,verified:boolean,run_id:string,created_at:timestamp>"
CITATION = "struct<path:string,start_line:int,end_line:int,verified:boolean>"

NODES = f"id long, repo_id string, kind string, fqname string, name string, path string, start_line int, end_line int, signature string, docstring string, metrics {METRICS}, summary string, embedding array<float>, annotations array<{ANNOTATION}>, content_hash string"
EDGES = "src long, dst long, kind string, confidence double"
CHUNKS = "id long, node_id long, path string, start_line int, end_line int, text string"
COMMUNITIES = "key string, node_ids array<long>, size int, title string, summary string"
EVENTS = "run_id string, seq long, ts timestamp, agent string, type string, payload string"
QUESTIONS = f"id string, repo_id string, owner string, text string, route string, answer string, session_id string, citations array<{CITATION}>, created_at timestamp"

SYMBOL = "struct<kind:string,fqname:string,name:string,start_line:int,end_line:int,signature:string,docstring:string,parent:string,source:string,bases:array<string>>"
IMPORT = "struct<module:string,imported:string,alias:string,line:int,relative:boolean,level:int>"
CALL = "struct<caller:string,callee:string,line:int>"
FILE_EXTRACT = f"path string, language string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>, had_errors boolean"
