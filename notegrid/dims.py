"""Rule tables of the knowledge-graph engine, as data.

Fixed values: these lists and numbers define the results and are stated as they
are. Tables that belong to one vault (projects, topics, folders) are parameters
of the operators instead.
"""

from __future__ import annotations

#: Weight of an edge by its type.
EDGE_WEIGHTS = {
    "wiki_link": 1.0, "related": 0.9, "uses": 0.8, "used_in": 0.8, "source": 0.7, "derived_from": 0.7, "applied_to": 0.7,
    "supports": 0.6, "contradicts": 0.6, "alternatives": 0.5, "participants": 0.5, "decisions": 0.5, "organization": 0.5, "tag_cooccurrence": 0.2,
}
DEFAULT_EDGE_WEIGHT = 0.5

#: Frontmatter fields that hold relations, in the order in which they are written.
RELATION_FIELDS = [
    "related", "uses", "used_in", "source", "derived_from", "supports", "contradicts", "applied_to", "alternatives", "participants", "decisions", "organization",
]

CORE_TYPES = ["person", "concept", "project", "tool", "insight", "source", "event", "decision", "note"]
TYPE_ALIASES = {
    "daily note": "event", "daily-note": "event", "daily": "event", "meeting": "event", "briefing": "event", "daily-briefing": "event",
    "session-log": "event", "update-check": "event", "task": "note", "stub": "note", "document": "note", "implementation": "note",
    "template": "note", "test": "note", "analysis": "source", "report": "source", "reference": "source", "reference note": "source",
    "guide": "source", "design": "concept", "project-memory": "project",
}

#: Words in the text around a link, the first match names the relation.
SEMANTIC_PATTERNS = [
    (r"(?:사용|활용|이용)(?:하|한|했)", "uses"),
    (r"(?:기반|based on|위에)", "uses"),
    (r"(?:참고|참조|inspired|영감)", "derived_from"),
    (r"(?:대안|대체|alternative|vs\.?|versus)", "alternatives"),
    (r"(?:지원|support|호환)", "supports"),
    (r"(?:반대|충돌|conflict|contradict)", "contradicts"),
]

#: A note's type by its name, the first match wins.
NAME_TYPES = [
    (r"Lessons?_?Learned|TIL|회고", "insight"),
    (r"미팅|회의|meeting|Meeting", "event"),
    (r"브리핑|Briefing|리포트|Report|Scan", "event"),
    (r"개발현황|Debugging|디버깅|devlog", "event"),
    (r"^A\d{3}-", "source"),
    (r"^D\d{3}-", "concept"),
    (r"^I\d{3}-", "note"),
    (r"^T\d{3}-", "note"),
    (r"설정|설치|Setup|Install|Config|config", "tool"),
    (r"_?api_?key|_?token|_?credential", "tool"),
    (r"전략|Strategy|Methodology|워크플로우|Architecture", "concept"),
    (r"사업계획|비즈니스|Business|PRD", "concept"),
]
#: A type to propose for a note without one, by its name.
PROPOSED_TYPES = [
    (r"^\d{4}-\d{2}-\d{2}", "event"),
    (r"^A\d{3}-", "source"),
    (r"^D\d{3}-", "concept"),
    (r"^I\d{3}-", "note"),
    (r"^T\d{3}-", "note"),
    (r"Lessons?_?Learned|TIL|회고", "insight"),
    (r"_개발현황", "event"),
    (r"_디버깅|_Debugging", "event"),
    (r"미팅|회의|meeting", "event"),
    (r"분석|Analysis|Research", "source"),
    (r"설계|Design|Architecture", "concept"),
    (r"브리핑|리포트|Report", "event"),
    (r"가이드|Guide|Tutorial", "source"),
    (r"설정|설치|Setup|Install|Config", "tool"),
    (r"_?api_?key|_?token|credential", "tool"),
    (r"전략|Strategy|Methodology", "concept"),
    (r"사업계획|Business|PRD", "concept"),
    (r"결정|선택|마이그레이션|전환|ADR", "decision"),
]
PROPOSED_FOLDERS = [("00.DAILY", "event"), ("TEMPLATES", "template"), ("tasks", "task"), ("docs", "document")]
FOLDER_TYPES = {
    "00.DAILY": "event", "01.PROJECT": "project", "02.AREA": "concept", "03.RESOURCES": "source", "04.ARCHIVE": "note", "05.DEBUGGING": "event",
    "tasks": "note", "docs": "note", "skills": "tool", "chatGPT": "source", "AI": "concept", "외부지식": "source", "스텁": "note",
}
#: Tags that speak for a type; ties go to the type that stands first. Names of a vault's
#: own projects aren't fixed values: `classify_notes` takes them as a parameter.
TAG_TYPES = {
    "person": ["person", "people", "team", "author", "mentor", "인물", "담당자", "고객", "파트너", "대표", "매니저", "developer", "engineer", "founder", "ceo", "cto"],
    "concept": [
        "concept", "idea", "theory", "principle", "pattern", "전략", "방법론", "아키텍처", "디자인패턴", "워크플로우",
        "methodology", "strategy", "workflow", "paradigm", "온톨로지", "프레임워크설계", "모델", "알고리즘",
    ],
    "project": ["project"],
    "tool": [
        "tool", "software", "framework", "library", "plugin", "language", "python", "typescript", "javascript", "react", "next", "node",
        "docker", "ollama", "railway", "vercel", "expo", "supabase", "postgres", "postgresql", "mongodb", "redis", "influxdb",
        "obsidian", "mcp", "api", "sdk", "cli", "git", "github", "vscode", "cursor", "claude", "openai", "gemini",
        "n8n", "playwright", "vitest", "pnpm", "bun", "npm", "cloudflare", "aws", "gcp", "azure", "terraform",
        "fastapi", "flask", "django", "express", "nextjs",
    ],
    "insight": ["insight", "lesson", "takeaway", "learning", "til", "회고", "retrospective", "발견", "교훈", "lessons-learned", "lessons_learned", "배운점"],
    "source": ["book", "video", "article", "paper", "podcast", "youtube", "blog", "외부지식", "참고자료", "레퍼런스", "reference"],
    "event": ["meeting", "event", "conference", "review", "daily", "미팅", "회의", "브리핑", "스프린트", "데모"],
    "decision": ["decision", "policy", "architecture", "결정", "선택", "마이그레이션", "전환", "채택", "폐기", "adr", "rfc"],
}
#: A type for a node without a record, by its extension, then (after date and folder) by words of its name.
EXTENSION_TYPES = {".pdf": "source", ".xlsx": "source", ".docx": "source", ".pptx": "source", ".csv": "source"}
UNKNOWN_KEYWORDS = [
    (["참고", "출처", "링크", "reference", "source"], "source"),
    (["결정", "합의", "decision", "policy"], "decision"),
    (["인사이트", "발견", "insight", "lesson"], "insight"),
    (["프로젝트", "project"], "project"),
    (["회의", "meeting", "daily"], "event"),
]

#: Metadata normalisation: other words for a status and, where TYPE_ALIASES has none, for a type.
STATUS_ALIASES = {
    "todo": "active", "done": "completed", "checked": "completed", "in-progress": "active", "review-needed": "active", "review_needed": "active", "inprogress": "active",
}
EXTRA_TYPE_ALIASES = {"newsletter": "source", "dashboard": "note", "memory": "project", "action-proposal": "concept"}
INFERRED_DATE_FIELDS = ["event_date", "decided", "created", "updated", "create_time"]
#: Words of a source's name, path, tags, headings or address that tell what it is, the first match wins.
SOURCE_HINTS = [
    ("video", ["youtube", "youtu.be", "vimeo", "video"]),
    ("podcast", ["podcast"]),
    ("newsletter", ["newsletter", "substack"]),
    ("paper", ["arxiv", "doi.org", "/paper", "paper", ".pdf"]),
    ("book", ["book", "ebook"]),
]
SOURCE_WEB_HINTS = ["blog", "article", "web"]
SOURCE_NOTE_HINTS = ["guide", "manual", "reference", "playbook", "template", "checklist", "workflow", "report", "analysis"]
SOURCE_NOTE_FOLDERS = ["docs", "tasks", "templates"]
#: Words that tell a tool's category, the first match wins.
TOOL_HINTS = [
    ("plugin", ["plugin", "obsidian plugin", "extension"]),
    ("language", ["python", "typescript", "javascript", "java", "kotlin", "swift", "go", "rust", "c++", "c#", "php", "ruby"]),
    ("framework", ["fastapi", "django", "flask", "react", "next", "nextjs", "express", "vue", "svelte", "tailwind", "shadcn"]),
    ("database", ["postgres", "postgresql", "mysql", "sqlite", "mongodb", "redis", "influxdb", "chromadb", "database"]),
    ("model", ["gpt", "claude", "gemini", "llama", "qwen", "embedding", "reranker", "model", "llm"]),
    ("platform", ["obsidian", "github", "docker", "platform", "openclaw", "railway", "vercel", "cloudflare", "aws", "gcp", "azure", "supabase"]),
    ("service", ["api", "gateway", "service", "oauth", "auth", "token", "secret", "monitoring", "security", "webhook", "openai", "google places"]),
    ("library", ["networkx", "numpy", "pandas", "rich", "click", "pyyaml", "pytest", "vitest", "esbuild"]),
    ("tool", ["tool", "cli", "sdk", "editor"]),
]
CHOSEN_PREFIXES = ["chosen:", "decision:", "selected:"]
RATIONALE_PREFIXES = ["rationale:", "reason:", "because:"]

#: Direction of an edge in a lineage, in the order of display.
LINEAGE_MODES = {
    "source": "target_upstream", "derived_from": "target_upstream", "uses": "target_upstream", "used_in": "target_downstream",
    "applied_to": "target_downstream", "decisions": "target_downstream", "supports": "target_upstream", "contradicts": "bidirectional",
    "alternatives": "bidirectional", "wiki_link": "bidirectional", "related": "bidirectional",
}
RESOLVE_PRIORITY = {"project": 9, "concept": 8, "tool": 7, "source": 7, "decision": 6, "insight": 6, "event": 5, "person": 5, "note": 2, "unknown": 0}

DATE_FIELDS = ["created", "updated", "event_date", "decided", "consumed", "first_met"]
URL_FIELDS = ["url", "github"]
ENUM_FIELDS = {
    "importance": ["high", "medium", "low"],
    "status": ["active", "paused", "completed", "archived"],
    "confidence": ["high", "medium", "low"],
    "source_type": ["book", "video", "article", "paper", "podcast", "blog", "course", "newsletter", "note"],
    "category": ["language", "framework", "service", "library", "plugin", "model", "database", "platform", "tool"],
}
RELATION_OWNERS = {
    "uses": ["project", "tool", "concept"], "used_in": ["tool"], "source": ["concept", "insight", "source", "note"],
    "derived_from": ["concept", "insight", "project", "decision"], "supports": ["concept", "insight", "decision"],
    "contradicts": ["concept", "insight", "decision"], "applied_to": ["insight", "concept"],
    "alternatives": ["tool", "project", "concept", "decision"], "participants": ["event"], "decisions": ["event"], "organization": ["person"],
}
RELATION_TARGETS = {
    "uses": ["tool", "concept", "project", "note"], "used_in": ["project"], "source": ["source", "note", "concept", "insight"],
    "derived_from": ["source", "concept", "insight", "decision", "note"], "supports": ["concept", "decision", "insight", "project"],
    "contradicts": ["concept", "decision", "insight"], "applied_to": ["project", "concept"],
    "alternatives": ["tool", "project", "concept", "decision", "note"], "participants": ["person", "project", "tool", "note"],
    "decisions": ["decision"], "organization": ["project", "person", "note"],
}
REQUIRED_FIELDS = {"tool": ["category"], "insight": ["source"], "source": ["source_type"], "event": ["event_date"], "decision": ["decided", "chosen", "rationale"]}
ANY_OF_FIELDS = {
    "person": ["role", "organization"], "concept": ["source", "related", "supports", "contradicts", "derived_from"],
    "project": ["local_path", "github", "uses", "related"], "tool": ["url", "used_in", "alternatives"], "insight": ["applied_to", "related"],
    "source": ["url", "author", "key_takeaways"], "event": ["participants", "decisions", "related"], "decision": ["context", "alternatives", "related"],
}
CARDINALITY = [("person", ["role", "organization"], 1), ("decision", ["chosen", "rationale", "alternatives"], 2)]
DEPENDENCY_RELATIONS = ["derived_from", "supports", "uses"]
INVERSE_RELATIONS = {"uses": "used_in", "used_in": "uses", "supports": "supported_by", "supported_by": "supports", "derived_from": "derives", "derives": "derived_from"}

#: Patterns of questions by kind, and the (keyword, vector, graph) weights of a kind.
QUESTION_PATTERNS = {
    "factual": [
        r"(아키텍처|구현|설정|설치|config|setup|install|구조|스키마|API|endpoint)",
        r"(어떻게|방법|how to|가이드|절차|단계)",
        r"(PRD|SRS|설계서|명세|스펙|specification)",
    ],
    "relational": [
        r"(관련|연결|시너지|연동|통합|영향|impact|relationship)",
        r"(누가|어디서|with|관련된|참여|참석|미팅에서|회의에서)",
        r"(사이|between|연관|cross|크로스)",
    ],
    "exploratory": [
        r"(비교|차이|vs|versus|대비|장단점|pros|cons)",
        r"(트렌드|동향|전망|기회|리스크|시장|market)",
        r"(전략|모델|방안|아이디어|브레인스토밍|가능성)",
        r"(최근|최신|latest|새로운|emerging|떠오르는)",
        r"(왜|why|이유|근거|배경|motivation)",
    ],
}
QUESTION_WEIGHTS = {"factual": (0.52, 0.30, 0.18), "relational": (0.40, 0.25, 0.35), "exploratory": (0.40, 0.40, 0.20)}
MODE_WEIGHTS = {"hybrid": (0.5, 0.3, 0.2), "vector": (0.0, 0.8, 0.2), "graph": (0.3, 0.0, 0.7), "keyword": (1.0, 0.0, 0.0)}

IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp"]
EXCLUDED_FOLDERS = [".obsidian", ".trash", ".git", "node_modules"]
