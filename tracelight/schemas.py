"""Types of the attribution model, as DDL, and its fixed values."""

ORIGINAL, AI, AI_MODIFIED, HUMAN, UNKNOWN = SOURCES = ("Original", "AI", "AIModified", "Human", "Unknown")
AI_KINDS = (AI, AI_MODIFIED)
HUMAN_KINDS = (ORIGINAL, HUMAN)

NOTE_VERSION = 3
PENDING_VERSIONS = (2, 3)
NOTE_WARN_BYTES = 512 * 1024
NOTE_MAX_BYTES = 4 * 1024 * 1024
SHORT_COMMIT = 7
PREVIEW = 60
AUDIT_EVENTS = ("delete", "export", "retention_apply", "config_change", "redaction")

SOURCE = "struct<type:string,edit_id:string,similarity:double>"
LINE = f"struct<line_number:bigint,content:string,source:{SOURCE},edit_id:string,prompt_index:bigint,confidence:double>"
COUNTERS = "struct<total_lines:bigint,ai_lines:bigint,ai_modified_lines:bigint,human_lines:bigint,original_lines:bigint,unknown_lines:bigint>"
PROMPT = "struct<index:bigint,text:string,timestamp:string,affected_files:array<string>>"
MODEL = "struct<id:string,provider:string>"
SESSION = f"struct<session_id:string,model:{MODEL},started_at:string,prompt_count:bigint,used_plan_mode:boolean,subagent_count:bigint>"
NOTE = f"struct<version:smallint,session:{SESSION},prompts:array<{PROMPT}>,files:array<struct<path:string,lines:array<{LINE}>,summary:{COUNTERS}>>>"

SNAPSHOT = "struct<content:string,content_hash:string,timestamp:string,line_count:bigint>"
CONTEXT = "struct<plan_mode:boolean,subagent_id:string,agent_depth:smallint,plan_step:bigint>"
EDIT = f"struct<edit_id:string,prompt:string,prompt_index:bigint,tool:string,before:{SNAPSHOT},after:{SNAPSHOT},timestamp:string,context:{CONTEXT}>"
REDACTION = "struct<pattern_name:string,char_range:array<bigint>,timestamp:string,preview:string>"
PENDING = (
    "struct<version:smallint,prompt_counter:bigint,audit_logging_enabled:boolean,total_redactions:bigint,"
    f"session:struct<session_id:string,model:{MODEL},started_at:string,prompt_count:bigint,"
    f"prompts:array<struct<index:bigint,text:string,timestamp:string,affected_files:array<string>,redaction_events:array<{REDACTION}>>>>,"
    f"file_histories:map<string,struct<path:string,was_new_file:boolean,original:{SNAPSHOT},edits:array<{EDIT}>>>>"
)

HOOK = (
    "repo string, session_id string, session_explicit boolean, seq bigint, tool string, file_path string, prompt string, "
    "old_content string, old_content_present boolean, new_content string, timestamp string, "
    "context struct<plan_mode:boolean,is_subagent:boolean,agent_depth:smallint,subagent_id:string>"
)
AUDIT = (
    "timestamp string, event string, commit string, reason string, format string, commit_count bigint, pattern_name string, "
    "redaction_count bigint, prev_hash string, event_hash string, user string, field string"
)
ATTRIBUTED = "path string, line_number bigint, content string, source_type string, edit_id string, prompt_index bigint, similarity double, confidence double"
AUDIT_FIELDS = tuple(x.split()[0] for x in AUDIT.split(", "))
