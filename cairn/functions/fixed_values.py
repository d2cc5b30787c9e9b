"""Word lists, patterns and constants that must be as they are for results to be right."""

from __future__ import annotations

#: Words without a topic.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "while", "of", "to", "in", "on", "at", "by", "for", "with", "from", "into", "onto", "over", "under", "about", "as", "is",
    "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "done", "doing", "have", "has", "had", "having", "it", "its", "this", "that", "these", "those", "there", "here", "i",
    "me", "my", "we", "our", "us", "you", "your", "he", "she", "they", "them", "their", "what", "which", "who", "whom", "whose", "why", "how", "can", "could", "should", "would", "will", "shall",
    "may", "might", "must", "not", "no", "yes", "so", "than", "too", "very", "just", "also", "only", "any", "all", "some", "each", "every", "more", "most", "other", "such", "own", "same",
    "please", "help", "need", "needs", "want", "wants", "like", "get", "got", "make", "makes", "made", "use", "uses", "used", "using", "let", "lets", "add", "adds", "fix", "fixes", "new", "old",
    "one", "two", "out", "up", "down", "off", "again", "further", "once", "code", "file", "files", "function", "functions", "project", "projects", "thing", "things", "way", "ways", "something",
    "anything", "handle", "handles", "handling", "set", "sets", "setup", "work", "works", "working", "build", "builds", "create", "creates", "implement", "implements", "implementation", "write",
    "writes", "change", "changes", "update", "updates", "improve", "improves", "good", "bad", "better", "task", "tasks", "issue", "issues", "problem", "problems", "step", "steps", "example",
    "examples", "question", "questions", "try", "tried", "trying", "look", "looks", "see", "know", "think", "go", "going",
)

#: Patterns of prompts about nothing that memory could hold, matched against the lower-cased prompt.
MECHANICAL = (
    r"\brename\b",
    r"\bre-?format\b",
    r"\bformat (?:this|the|it)\b",
    r"\bsort (?:the |these |those |my )?imports?\b",
    r"\b(?:fix|correct) (?:a |the )?typos?\b",
    r"\badd (?:a )?docstrings?\b",
    r"\badd (?:a )?(?:trailing )?newline\b",
    r"\b(?:delete|remove) (?:the |this |an? )?unused\b",
    r"\bbump (?:the )?version\b",
    r"\b(?:re-?)?indent\b",
    r"\bwrap (?:this|the) lines?\b",
    r"\badd (?:a )?type hints? to\b",
    r"\balphabet(?:ise|ize)\b",
)
WEAKLY_MECHANICAL = (
    r"\bconvert (?:this|the|it)\b",
    r"\binline (?:this|the)\b",
    r"\bextract (?:this|the) (?:variable|constant|method)\b",
    r"\bmove (?:this|the) (?:function|class|method)\b",
    r"\brewrite (?:this|the) (?:line|expression)\b",
    r"\bswap\b",
)
EXPLAINING = (
    r"^what (?:does|is) (?:this|that)\b",
    r"^explain (?:this|that|what)\b",
    r"^explain the (?:code|function|class|method|file|snippet|error|output|stack ?trace|loop|test|lines?|diff|regex|query|variable|import|decorator)\b",
    r"^what'?s (?:this|that)\b",
    r"\bwhat does (?:this|the) \w+ do\b",
)
AUTOMATED = r"^<(?:task-notification|system-reminder|local-command-[a-z]+|command-(?:name|message|args)|bash-(?:input|stdout|stderr)|user-prompt-submit-hook)>"

#: Patterns that speak for a task, by task; ties go to the task named first.
TASK_SIGNALS = {
    "debug": (
        r"\berrors?\b",
        r"\bbugs?\b",
        r"\bcrash(?:es|ing|ed)?\b",
        r"\bfail(?:s|ing|ed|ure)?\b",
        r"\bexceptions?\b",
        r"\btraceback\b",
        r"\bstack trace\b",
        r"\bnot working\b",
        r"\bdoes ?n'?o?t work\b",
        r"\bbroken\b",
        r"\bwhy (?:is|does|am|are|do)\b",
        r"\bnan\b",
        r"\btimed? ?out\b",
        r"\bout of memory\b",
        r"\boom\b",
        r"\bhangs?\b",
        r"\bstalls?\b",
        r"\bdrifts?\b",
        r"\bwrong (?:answer|output|result)\b",
        r"\bworse\b",
        r"\bterrible\b",
        r"\bcollapse[ds]?\b",
        r"\bmismatch\b",
        r"\bleak(?:s|ing|age)?\b",
        r"\bcannot parse\b",
        r"\bmalformed\b",
        r"\bdegrad(?:es|ed|ing)\b",
        r"\bslow(?:er)?\b",
        r"\bidle\b",
        r"\butili[sz]ation\b",
        r"\bbottleneck\b",
        r"\b(?:is|are|seems?|looks?|sits?) (?:at |too )?low\b",
        r"\bimplausib\w+\b",
        r"\bsuspicious\w*\b",
        r"\bunexpected\w*\b",
        r"\bregress(?:ion|ed|ing)?\b",
    ),
    "architect": (
        r"\bshould i\b",
        r"\bwhich (?:one|approach|library|framework|database|tool)\b",
        r"\bdesign(?:ing)?\b",
        r"\barchitect(?:ure)?\b",
        r"\bstructure\b",
        r"\bhow should i\b",
        r"\bwhat'?s the best way\b",
        r"\b[\w.-]+ or [\w.-]+\b(?=[^?]*\?)",
        r"\bstarting a new\b",
        r"\bfrom scratch\b",
        r"\btrade-?offs?\b",
        r"\bwhere should\b",
        r"\boptions\b",
    ),
    "explore": (
        r"\bhow did i\b",
        r"\bwhat did i\b",
        r"\bdid i (?:ever|use|try|do|end up)\b",
        r"\bhave i (?:ever|done|used|tried)\b",
        r"\blast time\b",
        r"\bpreviously\b",
        r"\bin the past\b",
        r"\bwhat if\b",
        r"\bis it worth\b",
        r"\bany thoughts\b",
        r"\bthinking about\b",
        r"\bresearch(?:ing)?\b",
        r"\bcompare\b",
        r"\binvestigate\b",
        r"\bbefore i\b",
        r"\bfastest route\b",
        r"\bhave i\b",
        r"\bdid i ever\b",
        r"\bexplore\b",
    ),
    "refactor": (
        r"\brefactor\b",
        r"\bclean ?up\b",
        r"\brestructure\b",
        r"\bsimplify\b",
        r"\bsplit (?:this|the|up)\b",
        r"\bdeduplicat\w*\b",
        r"\btidy\b",
        r"\bmake (?:this|it) reproducible\b",
    ),
    "implement": (
        r"\badd\b",
        r"\bimplement\b",
        r"\bbuild\b",
        r"\bcreate\b",
        r"\bwrite\b",
        r"\bset ?up\b",
        r"\bwire (?:up|in)\b",
        r"\bsupport for\b",
        r"\bhandle\b",
        r"\bhook up\b",
    ),
}

#: The record types that a task may see.
RECORD_TYPES = {
    "debug": ("failure", "reversal"),
    "architect": ("decision", "reversal", "failure", "experiment", "research"),
    "explore": ("decision", "experiment", "research", "reversal", "failure"),
    "refactor": ("decision", "failure", "reversal"),
    "implement": ("decision", "failure", "experiment", "reversal"),
}

#: Other names of entities.
ALIASES = {
    "postgresql": "postgres",
    "psql": "postgres",
    "pg": "postgres",
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "sklearn": "scikit-learn",
    "scikit": "scikit-learn",
    "torch": "pytorch",
    "yolo": "yolov8",
    "yolov5": "yolov8",
    "yolov11": "yolov8",
    "oom": "cuda",
    "out-of-memory": "cuda",
    "gpt": "llm",
    "openai": "llm",
    "claude": "llm",
    "anthropic": "llm",
    "nextjs": "nextjs",
    "next.js": "nextjs",
    "next": "nextjs",
    "tailwind": "tailwindcss",
    "dataloader": "dataloader",
    "num_workers": "dataloader",
    "k-fold": "kfold",
    "kfold": "kfold",
    "walkforward": "walk-forward",
    "onnxruntime": "onnx",
    "docker-compose": "docker-compose",
    "compose": "docker-compose",
}

#: Endings that leave a word the same word.
INFLECTIONS = ("s", "es", "d", "ed", "ing", "er", "ers", "ly")

#: A line that reports a measured result.
METRIC_LINE = (
    r"(?i)\b(?:score|dice|iou|f1|auc|roc|rmse|mae|mse|loss|acc(?:uracy)?|precision|recall|cv|lb|leaderboard|fold|epoch|val|valid|metric|ndcg|mrr|map|bleu|rouge|wer|cer)\b"
    r"[^\n]{0,60}?[:=\s]\s*-?\d+\.\d+"
)

#: Phrases that mark a stated reason in a commit message.
REASONS = (
    r"\bbecause\b", r"\bso that\b", r"\bin order to\b", r"\bthe reason\b", r"\bwhy:\s*", r"\brationale:\s*", r"\bmotivation:\s*",
    r"\bthis (?:lets|means|avoids|removes|fixes|stops)\b", r"\bturned out\b", r"\bit turns out\b",
)
#: Lines of a commit message that are not about the commit.
TRAILER = r"(?i)^\s*(?:co-authored-by|signed-off-by|reviewed-by|acked-by|tested-by|reported-by|change-id|cc|fixes|closes|resolves|see|refs?)\s*[:#]|^\s*(?:\x{1F916}\s*)?generated (?:with|by)\b|^\s*https?://\S+\s*$"
#: The conventional form of a commit's first line.
CONVENTIONAL = r"(?i)^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(?:\(([^)]*)\))?(!)?:\s*(.+)$"
#: Phrases before an alternative that was dropped.
ALTERNATIVES = (
    r"(?i)instead of\s+([^.,;\n]{2,48})", r"(?i)rather than\s+([^.,;\n]{2,48})", r"(?i)in place of\s+([^.,;\n]{2,48})", r"(?i)over\s+([^.,;\n]{2,40})\s+because",
    r"(?i)dropped\s+([^.,;\n]{2,40})", r"(?i)moved off\s+([^.,;\n]{2,40})", r"(?i)replaced?\s+([^.,;\n]{2,40})\s+with",
)

#: Words of a commit about something that went wrong.
FAILURE_WORDS = (
    r"\bbug\b", r"\bbroken\b", r"\bregress(?:ion|ed)\b(?!\s+(?:test|tests|harness|suite|model|task|head|target))", r"\bcrash(?:es|ed|ing)?\b", r"\bleak(?:s|ed|ing|age)?\b", r"\bdeadlock\b",
    r"\brace condition\b", r"\bout of memory\b", r"\boom\b", r"\bnan\b", r"\bhang(?:s|ing)?\b", r"\btimeout\b", r"\bcorrupt\w*\b", r"\bwrong\b", r"\bincorrect\b", r"\bsilently\b",
    r"\bnever (?:fired|ran|worked)\b", r"\bwas not\b", r"\bfail(?:s|ed|ing|ure)\b", r"\bmismatch\b", r"\bedge case\b",
)
#: First lines of commits that are never worth a record.
NOISE_SUBJECTS = (
    r"^wip\b", r"^tmp\b", r"^temp\b", r"^\.+$", r"^merge branch '(?:main|master|develop)'", r"^update(?:d)? (?:readme|docs|changelog|dependencies|deps|lockfile)\.?$", r"^bump\b", r"^initial commit$",
    r"^first commit$", r"^\s*$", r"^format\b", r"^lint\b", r"^typo\b", r"^fix typo", r"^minor\b", r"^cleanup\.?$", r"^chore\(deps\)",
)
#: Conventional types that carry no decision, and those by which the author says that nothing went wrong.
UNINTERESTING_TYPES = ("style", "chore", "ci", "build", "test", "docs")
NO_FAILURE_TYPES = ("feat", "docs", "style", "test", "chore", "ci", "build")
#: Technical terms that a commit may name.
TECH_LEXICON = (
    "alembic", "albumentations", "asyncio", "auth", "aws", "axum", "bert", "bloc", "bm25", "cache", "caching", "celery", "ci", "cnn", "colab", "convnext", "crnn", "cross-validation", "ctc", "cuda",
    "dataloader", "diarisation", "distilbert", "django", "docker", "docker-compose", "dropout", "embeddings", "fastapi", "fastembed", "ffmpeg", "firebase", "firestore", "flask", "flutter", "freezed",
    "gcp", "gradio", "graphql", "grpc", "gunicorn", "hnsw", "huggingface", "imbalance", "jwt", "kafka", "kfold", "keras", "kubernetes", "langchain", "langgraph", "lightgbm", "llm", "lstm", "migration",
    "mlflow", "mongodb", "mypy", "nextjs", "nginx", "numpy", "onnx", "opencv", "optuna", "pandas", "pgvector", "pinecone", "pipeline", "poetry", "postgres", "prisma", "prometheus", "pydantic", "pytest",
    "pytorch", "quantisation", "rabbitmq", "rag", "react", "redis", "riverpod", "roboflow", "ruff", "s3", "scikit-learn", "sentry", "shap", "smote", "sqlalchemy", "sqlite", "streamlit", "supabase",
    "tailwindcss", "tanstack-query", "tensorflow", "terraform", "tesseract", "timm", "tokio", "torch", "transformers", "trocr", "typescript", "ultralytics", "uv", "uvicorn", "vector-store",
    "walk-forward", "webpack", "whisper", "xgboost", "yolov8", "zod",
)

#: Labels of hosts that exist to sign someone in, prefixes of such labels, and names that resolve only locally.
SIGN_IN_LABELS = ("login", "signin", "sign-in", "sso", "auth", "authn", "oauth", "account", "accounts", "identity", "secure")
SIGN_IN_PREFIXES = ("login-", "signin-", "static-login", "authentication", "authn-", "sso-", "secure-")
LOCAL_SUFFIXES = (".local", ".localhost", ".internal", ".lan", ".home.arpa")

#: Constants of retrieval and ranking.
COMMON_SHARE, COMMON_MIN_CORPUS = 0.25, 200
MISSING_TERM = 0.75
NAMED_BOOST, SAME_PROJECT_BOOST = 1.3, 1.15
COVERAGE_FLOOR, NAMED_FLOOR = 0.6, 0.35
RECORD_COVERAGE_FLOOR = 0.07
CANDIDATES, PROJECT_CANDIDATES = 40, 15
ANCHORS, PER_DOCUMENT, NEAR_DUPLICATE = 2, 2, 0.75
RARE_SHARE, RARE_MIN = 0.05, 3
MAX_EVIDENCE = 4
EXCERPT_LINES, EXCERPT_CHARS = 12, 1000
RRF_K, PER_RETRIEVER = 10, 30
LEXICAL_WEIGHT, VECTOR_WEIGHT, TIE_WEIGHT = 0.6, 0.4, 0.1
MIN_SIMILARITY, MIN_SCORE, RELATIVE_FLOOR = 0.15, 0.38, 0.85
BASELINE_SCORE, NAMED_RELEVANCE = 0.25, 0.3
SERVE_CONFIDENCE, HALF_LIFE_DAYS = 0.6, 240.0
TTL_DAYS = {"tool_preference": 90, "work_style": 180, "abandoned": 365, "constraint": 180}
PROFILE_TOKENS, EPISODIC_TOKENS, TOTAL_TOKENS, EVIDENCE_TOKENS = 800, 1500, 2300, 1200
MAX_STATEMENTS, MAX_RECORDS = 15, 5
LONG_PROMPT_WORDS, TRIVIAL_WORDS = 250, 12
