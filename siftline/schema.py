"""The data model: documents, comments, sources, queue jobs."""

from __future__ import annotations

VERSION = 1

DOCUMENT = """
id string, content_hash string, simhash string, url string, canonical_url string, domain string, source_type string, source_id string,
platform_post_id string, title string, excerpt string, body string, body_len long, body_source string, language string,
language_confidence double, script string, translit_body string,
author struct<id:string,name:string,handle:string,url:string,verified:boolean>, published_at long, crawled_at long, indexed_at long,
published_at_precision string, sentiment struct<label:string,score:double,confidence:double,model:string>,
engagement struct<likes:long,comments:long,shares:long,views:long,captured_at:long>, comments_count long,
media array<struct<type:string,url:string,thumb_url:string,width:int,height:int,ocr_text:string,ocr_lang:string,embedding_id:string,phash:string>>,
entities array<string>, topics array<string>, geo struct<wilaya:string,wilaya_name:string>, quality_score double, spam_score double,
is_nsfw boolean, robots_indexable boolean, http_status int, fetch_method string, access_path string, schema_version int
"""

COMMENT = "id string, document_id string, parent_comment_id string, author string, body string, published_at long, likes long"
SOURCE = "source_id string, url string, tier string, trust double, crawl_trust int"
JOB = "document string, index string"

#: Trust tiers, for ranking and for crawling.
TRUST = {"A": 1.0, "B": 0.6, "C": 0.3}
CRAWL_TRUST = {"A": 100, "B": 60, "C": 30}
#: Other spellings of enumerated values.
ALIASES = {"fb": "facebook", "ig": "instagram", "yt": "youtube", "dz": "ary", "darija": "ary"}
