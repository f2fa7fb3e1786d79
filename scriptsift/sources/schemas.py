"""Table schemas."""

RESPONSES = (
    "response_id bigint, url string, status_code int, content string, content_type string, "
    "content_length bigint, content_hash string, final_url string, headers map<string,string>, "
    "error string, captured_at timestamp"
)
PAGES = "page_id bigint, url string, html string"
PROJECTS = (
    "id bigint, name string, target_url string, scope_patterns string, created_at timestamp, "
    "updated_at timestamp, notes string"
)
ASSETS = (
    "id bigint, project_id bigint, url string, asset_type string, content_hash string, content string, "
    "beautified_content string, source_mapped_content string, is_chunk boolean, chunk_id string, "
    "parent_url string, status_code int, content_length bigint, discovered_at timestamp, analyzed boolean, "
    "has_sourcemap boolean, sourcemap_url string"
)
FINDINGS = (
    "id bigint, project_id bigint, asset_id bigint, finding_type string, category string, value string, "
    "context string, line_number int, confidence string, severity string, is_bookmarked boolean, "
    "notes string, discovered_at timestamp, pattern_name string"
)
CUSTOM_PATTERNS = (
    "id bigint, project_id bigint, name string, pattern_type string, pattern string, finding_type string, "
    "severity string, description string, enabled boolean, created_at timestamp"
)
