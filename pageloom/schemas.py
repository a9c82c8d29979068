"""Schemas of the tables the jobs read and write, as DDL."""

PAGES = "page_id bigint, url string, html string"

CRAWL_TASK = "url string, depth int, crawler_id string, parent_url string, site_id string"

CRAWL_RECORD = (
    "url string, content string, content_bytes binary, status_code int, "
    "headers map<string,string>, ts timestamp, links array<string>, mimetype string, "
    "metadata struct<source:string,url:string,title:string,meta_description:string,"
    "meta_keywords:string,og:map<string,string>,"
    "headings:array<struct<level:int,text:string>>,images:array<struct<src:string,alt:string>>>, "
    "content_hash string, site_id string, task_id string, redirect_url string"
)

DOCUMENT = (
    "document_id bigint, url string, content_hash string, title string, description string, "
    "keywords string, source string, mimetype string, status_code int, content string, "
    "clean_content string, links array<string>, version int, index_operation string, "
    "is_indexed boolean, created_at timestamp, updated_at timestamp"
)

MEMBERSHIP = "site_id string, document_id bigint, created_at timestamp"

HISTORY = (
    "document_id bigint, url string, content_hash string, version int, change_type string, "
    "created_at timestamp, title string, description string, content_length bigint, "
    "clean_content_length bigint, site_id string"
)

NODE = (
    "node_id string, doc_id string, site_id string, chunk_no int, text string, "
    "embedding array<float>, sparse map<int,double>"
)

TASK_EVENT = "queue string, task_id string, event string, ts timestamp, seq bigint, processing_time double"

SEARCH_LOG = (
    "log_id bigint, query string, search_type string, site_id string, results_count bigint, "
    "execution_time_ms double, result_ids array<bigint>, feedback int, created_at timestamp"
)

GLOSSARY_ENTRY = "struct<full_name:string,translation:string,remarks:string>"

EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)

TASK_EVENTS = ("enqueue", "dequeue", "complete", "fail", "retry")
TASK_STATES = ("pending", "processing", "completed", "failed", "retry")
CHANGE_TYPES = ("new", "edit", "delete")
SCHEDULE_TYPES = ("once", "interval", "cron")
REFRESH_STRATEGIES = ("all", "incremental", "selective")
