"""Schemas of the relational tables that a collection of notes becomes."""

FILES = (
    "path string, name string, name_key string, path_key string, extension string, folder string, "
    "size bigint, mtime bigint, ctime bigint, content string, frontmatter string"
)
LINKS = (
    "source string, target string, target_key string, target_path_key string, alias string, "
    "heading string, block_id string, is_embed boolean"
)
TAGS = "file_path string, tag string, in_frontmatter boolean"
TASKS = "file_path string, line_number int, status string, text string, due_date string"
BLOCKS = "file_path string, block_id string, content string, line_number int"
INLINE_FIELDS = "file_path string, key string, key_norm string, value string, line_number int"
CHANGE_EVENT = "path string, type string, mtime bigint, size bigint, seq bigint, ts timestamp"
DIAGNOSTIC = (
    "file string, line int, column int, rule string, severity string, message string, "
    "target string, reason string, suggestions array<string>, fixable boolean"
)
NODE = (
    "type string, target string, alias string, heading string, block_id string, embed boolean, "
    "text string, title string, image boolean, value string, status string, key string, foldable boolean, "
    "content string, line int, column int, raw string"
)
TABLES = {"files": FILES, "links": LINKS, "tags": TAGS, "tasks": TASKS, "blocks": BLOCKS, "inline_fields": INLINE_FIELDS}

# fixed values: extensions of embedded files that are not notes
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "mp4", "webm", "mov", "mp3", "wav", "ogg", "pdf",
)
