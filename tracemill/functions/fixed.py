"""Fixed values of the record format: they must stay as they are for results to agree with existing data."""

SCHEMA_VERSION = "0.1.0"

# Vocabularies.
OUTCOME_TAGS = (
    "task_completed", "task_partial", "task_failed", "hallucination", "minor_hallucination", "tool_call_correct",
    "tool_call_failed", "tool_not_found", "wrong_format", "context_overflow", "slow_response", "perfect", "safety_issue",
    "refusal_appropriate", "refusal_inappropriate", "loop_detected", "instruction_following", "instruction_drift",
)
PAIN_POINT_CATEGORIES = (
    "tool_call_failure", "tool_call_wrong_tool", "hallucination_factual", "hallucination_tool", "context_loss",
    "format_error", "reasoning_error", "performance_issue", "safety_concern", "ux_friction", "skill_gap", "other",
)
SEVERITIES = ("low", "medium", "high", "critical")
CONSENT_LEVELS = ("trajectory_only", "metadata_only", "full", "anonymous")
TOOL_STATUSES = ("success", "failure", "timeout", "error")
DIFFICULTIES = ("trivial", "easy", "medium", "hard", "expert")
RECORD_TYPES = ("task_trajectory", "pain_point", "benchmark_run")
PROVIDERS = ("ollama", "vllm", "sglang", "llamacpp", "openrouter", "custom")
ROLES = ("human", "gpt")
TIER_RANKS = {"gold": 4, "silver": 3, "bronze": 2, "review_needed": 1}

# Patterns to redact, in the order in which they apply: (category, pattern, placeholder).
SCRUB_PATTERNS = (
    ("file_paths", r"/home/[a-zA-Z0-9_.-]+/\S*", "[REDACTED_PATH]"),
    ("file_paths", r"/Users/[a-zA-Z0-9_.-]+/\S*", "[REDACTED_PATH]"),
    ("file_paths", r"C:\\Users\\[a-zA-Z0-9_.-]+\\\S*", "[REDACTED_PATH]"),
    ("file_paths", r"~/\S+", "[REDACTED_PATH]"),
    ("api_keys", r"sk-[a-zA-Z0-9]{32,}", "[REDACTED_KEY]"),
    ("api_keys", r"ghp_[a-zA-Z0-9]{36}", "[REDACTED_KEY]"),
    ("api_keys", r"glpat-[a-zA-Z0-9\-]{20,}", "[REDACTED_KEY]"),
    ("api_keys", r"AKIA[0-9A-Z]{16}", "[REDACTED_KEY]"),
    ("api_keys", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "[REDACTED_KEY]"),
    ("api_keys", r"Bearer\s+[a-zA-Z0-9._-]+", "[REDACTED_KEY]"),
    ("api_keys", r"""token['"]?\s*[:=]\s*['"][^'"]+['"]""", "[REDACTED_KEY]"),
    ("network", r"[a-zA-Z0-9-]+\.(internal|local|corp|lan)\b", "[REDACTED_HOSTNAME]"),
    ("hex_tokens", r"""(?i:(?:key|token|secret|password|apikey|api_key|auth|credential)['"\s]*[:=]['"\s]*([a-fA-F0-9]{40,}))""", "[REDACTED_HEX_TOKEN]"),
    ("emails", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"\b\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("crypto", r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----", "[REDACTED_CERT]"),
    ("crypto", r"ssh-[a-z0-9]+ AAAA[a-zA-Z0-9+/]+[=]{0,2}", "[REDACTED_CERT]"),
    ("connection_strings", r"(postgres|mysql|mongodb|redis)://[^\s]+", "[REDACTED_CONNSTR]"),
    ("connection_strings", r"Server=[^;]+;Database=[^;]+;", "[REDACTED_CONNSTR]"),
)
CATEGORIES = ("file_paths", "api_keys", "network", "emails", "phone", "crypto", "connection_strings")
# Counted under another category.
COUNTED_AS = {"hex_tokens": "api_keys"}
IPV4 = r"((?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?))"
IP_PLACEHOLDER = "[REDACTED_IP]"
# Words after which four numbers are a version, if they end within 30 characters before it.
VERSION_WORDS = ("python", "node", "ruby", "java", "go", "perl", "php", "pip", "npm", "cuda", "version", "ver", "v", "v.", "release")
VERSION_REACH = 30
ORG_DOMAIN = r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.(?:company|org|io)\b"
SAFE_DOMAINS = ("github.io", "python.org", "nodejs.org", "apache.org", "mozilla.org", "npmjs.org", "readthedocs.org", "crates.io", "rubygems.org", "pypi.org", "docker.io")

# Hardware families: the first pattern found in a name, without regard to case.
GPU_FAMILIES = (
    (r"NVIDIA\s+(?:GeForce\s+)?RTX\s+50\d{2}(?:\s+(?:Ti|SUPER))?", "NVIDIA RTX 50xx"),
    (r"NVIDIA\s+(?:GeForce\s+)?RTX\s+40\d{2}(?:\s+(?:Ti|SUPER))?", "NVIDIA RTX 40xx"),
    (r"NVIDIA\s+(?:GeForce\s+)?RTX\s+30\d{2}(?:\s+(?:Ti|SUPER))?", "NVIDIA RTX 30xx"),
    (r"NVIDIA\s+(?:GeForce\s+)?RTX\s+20\d{2}(?:\s+(?:Ti|SUPER))?", "NVIDIA RTX 20xx"),
    (r"NVIDIA\s+(?:GeForce\s+)?GTX\s+16\d{2}(?:\s+(?:Ti|SUPER))?", "NVIDIA GTX 16xx"),
    (r"NVIDIA\s+(?:GeForce\s+)?GTX\s+10\d{2}(?:\s+(?:Ti))?", "NVIDIA GTX 10xx"),
    (r"NVIDIA\s+A100", "NVIDIA A100"),
    (r"NVIDIA\s+A[46]000", "NVIDIA Axxxx"),
    (r"NVIDIA\s+H100", "NVIDIA H100"),
    (r"NVIDIA\s+L40", "NVIDIA L40"),
    (r"AMD\s+(?:Radeon\s+)?RX\s+7\d{3}", "AMD RX 7000"),
    (r"AMD\s+(?:Radeon\s+)?RX\s+6\d{3}", "AMD RX 6000"),
    (r"AMD\s+Instinct\s+MI\d+", "AMD Instinct"),
    (r"Apple\s+M[1-9]", "Apple Silicon"),
    (r"Intel\s+Arc\s+A\d+", "Intel Arc"),
)
OTHER_GPU = "Other GPU"
MEMORY_TIERS = (4, 8, 16, 32, 64, 128, 256, 512)
REDACTED_CONTENT = "[REDACTED_CONTENT]"
SHARDS = 256
JITTER_SECONDS = 1800
TOOL_TEXT = 2000
