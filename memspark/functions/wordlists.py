"""Word lists, tables and patterns that decide results. All are defaults of parameters."""

# Fixed values.
READABLE_EXTENSIONS = (".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml")
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", "target")
CHAT_EXTENSIONS = (".txt", ".md", ".json", ".jsonl")

# Words of each topic, in order of preference.
TOPICS = {
    "technical": ("code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"),
    "architecture": ("architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"),
    "planning": ("plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"),
    "decisions": ("decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"),
    "problems": ("problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"),
}

# Folder names of each room. Their order decides results: the rooms' order where scores are equal, and the
# names' order, room after room, where a file's stem has several.
ROOM_FOLDERS = {
    "frontend": ("frontend", "front-end", "front_end", "client", "ui", "views", "components", "pages"),
    "backend": ("backend", "back-end", "back_end", "server", "api", "routes", "services", "controllers", "models", "database", "db", "auth"),
    "documentation": ("docs", "doc", "documentation", "wiki", "readme", "notes"),
    "design": ("design", "designs", "mockups", "wireframes", "assets", "storyboard"),
    "costs": ("costs", "cost", "budget", "finance", "financial", "pricing", "invoices", "accounting"),
    "meetings": ("meetings", "meeting", "calls", "meeting_notes", "standup", "minutes"),
    "team": ("team", "staff", "hr", "hiring", "employees", "people"),
    "research": ("research", "references", "reading", "papers"),
    "planning": ("planning", "roadmap", "strategy", "specs", "requirements"),
    "testing": ("tests", "test", "testing", "qa"),
    "scripts": ("scripts", "tools", "utils"),
    "configuration": ("config", "configs", "settings", "infrastructure", "infra", "deploy"),
}

# Codes of feelings by the words that show them.
EMOTION_SIGNALS = {
    "decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage",
    "hope": "hope", "fear": "fear", "trust": "trust", "happy": "joy", "sad": "grief", "surprised": "surprise", "grateful": "grat", "curious": "curious",
    "wonder": "wonder", "anxious": "anx", "relieved": "relief", "satisf": "satis", "disappoint": "grief", "concern": "anx",
}
FLAG_SIGNALS = {
    "decided": "DECISION", "chose": "DECISION", "switched": "DECISION", "migrated": "DECISION", "replaced": "DECISION", "instead of": "DECISION", "because": "DECISION",
    "founded": "ORIGIN", "created": "ORIGIN", "started": "ORIGIN", "born": "ORIGIN", "launched": "ORIGIN", "first time": "ORIGIN",
    "core": "CORE", "fundamental": "CORE", "essential": "CORE", "principle": "CORE", "belief": "CORE", "always": "CORE", "never forget": "CORE",
    "turning point": "PIVOT", "changed everything": "PIVOT", "realized": "PIVOT", "breakthrough": "PIVOT", "epiphany": "PIVOT",
    "api": "TECHNICAL", "database": "TECHNICAL", "architecture": "TECHNICAL", "deploy": "TECHNICAL", "infrastructure": "TECHNICAL", "algorithm": "TECHNICAL",
    "framework": "TECHNICAL", "server": "TECHNICAL", "config": "TECHNICAL",
}
EMOTION_CODES = {
    "vulnerability": "vul", "vulnerable": "vul", "joy": "joy", "joyful": "joy", "fear": "fear", "mild_fear": "fear", "trust": "trust", "trust_building": "trust",
    "grief": "grief", "raw_grief": "grief", "wonder": "wonder", "philosophical_wonder": "wonder", "rage": "rage", "anger": "rage", "love": "love", "devotion": "love",
    "hope": "hope", "despair": "despair", "hopelessness": "despair", "peace": "peace", "relief": "relief", "humor": "humor", "dark_humor": "humor",
    "tenderness": "tender", "raw_honesty": "raw", "brutal_honesty": "raw", "self_doubt": "doubt", "anxiety": "anx", "exhaustion": "exhaust",
    "conviction": "convict", "quiet_passion": "passion", "warmth": "warmth", "curiosity": "curious", "gratitude": "grat", "frustration": "frust",
    "confusion": "confuse", "satisfaction": "satis", "excitement": "excite", "determination": "determ", "surprise": "surprise",
}
DECISION_WORDS = ("decided", "because", "instead", "prefer", "switched", "chose", "realized", "important", "key", "critical", "discovered", "learned", "conclusion", "solution", "reason", "why", "breakthrough", "insight")

# Words that are no topics.
TOPIC_STOPWORDS = tuple(
    """a about above after again all also an and are as at be because been before being below between both but by can could did do
    does don down during each every few for from further get got had has have he her here him his how i if in into is it its just
    like made make many may me might more most much my need no nor not now of off on once only or other our out over own really
    same shall she should since so some such than that the their them then there these they thing things this those through to too
    under up us use used using very want was way we well were what when where which while who whom why will with would you your""".split()
)

# Patterns of each class of memory, in order of preference.
MEMORY_PATTERNS = {
    "decision": (
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b", r"\bbetter (to|than|approach|option|choice)\b",
        r"\binstead of\b", r"\brather than\b", r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b", r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b",
        r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b", r"\binfrastructure\b", r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ),
    "preference": (
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b", r"\bi hate (when|how|it when)\b",
        r"\bplease (always|never|don'?t)\b", r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b", r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b",
        r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ),
    "milestone": (
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b", r"\bcracked (it|the)\b", r"\bfinally\b",
        r"\bfirst time\b", r"\bfirst ever\b", r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b", r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b",
        r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b", r"\bcreated\b", r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b",
        r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b", r"\bversion \d", r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)", r"\d+% (reduction|improvement|faster|better|smaller)",
    ),
    "problem": (
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b", r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b",
        r"\bthe (problem|issue|bug) (is|was)\b", r"\bturns out\b.*\b(was|because|due to)\b", r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b",
        r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b", r"\bpatched\b", r"\bthe answer (is|was)\b", r"\b(had|need) to\b.*\binstead\b",
    ),
    "emotional": (
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b",
        r"\blonely\b", r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b", r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone",
        r"nobody knows", r"\*[^*]+\*",
    ),
}

# What stands beside names. The name's place is {name}.
PERSON_PATTERNS = (
    r"\b{name}\s+said\b", r"\b{name}\s+asked\b", r"\b{name}\s+told\b", r"\b{name}\s+replied\b", r"\b{name}\s+laughed\b", r"\b{name}\s+smiled\b", r"\b{name}\s+cried\b", r"\b{name}\s+felt\b",
    r"\b{name}\s+thinks?\b", r"\b{name}\s+wants?\b", r"\b{name}\s+loves?\b", r"\b{name}\s+hates?\b", r"\b{name}\s+knows?\b", r"\b{name}\s+decided\b", r"\b{name}\s+pushed\b", r"\b{name}\s+wrote\b",
    r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b", r"\bhi\s+{name}\b", r"\bdear\s+{name}\b",
)
PROJECT_PATTERNS = (
    r"\bbuilding\s+{name}\b", r"\bbuilt\s+{name}\b", r"\bship(?:ping|ped)?\s+{name}\b", r"\blaunch(?:ing|ed)?\s+{name}\b", r"\bdeploy(?:ing|ed)?\s+{name}\b", r"\binstall(?:ing|ed)?\s+{name}\b",
    r"\bthe\s+{name}\s+architecture\b", r"\bthe\s+{name}\s+pipeline\b", r"\bthe\s+{name}\s+system\b", r"\bthe\s+{name}\s+repo\b", r"\b{name}\s+v\d+\b", r"\b{name}\.py\b", r"\b{name}-core\b",
    r"\b{name}-local\b", r"\bimport\s+{name}\b", r"\bpip\s+install\s+{name}\b",
)

# Words that are names, too.
AMBIGUOUS_WORDS = tuple(
    """ever grace will bill mark april may june joy hope faith chance chase hunter dash flash star sky river brook lane art clay gil nat
    max rex ray jay rose violet lily ivy ash reed sage monday tuesday wednesday thursday friday saturday sunday january february march
    july august september october november december""".split()
)
#: Words at the start of sentences that aren't names. The full list is the caller's: pass ``stopwords``.
NAME_STOPWORDS = tuple(dict.fromkeys((*TOPIC_STOPWORDS, "will", "let", "yes", "okay", "please", "today", "tomorrow", "yesterday", "hello", "thanks")))
# The line with a session's time (time, month, day, year), and what begins prompts that tell no subject.
CLOCK = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
SKIPPED_PROMPTS = (r"\./", "cd ", "ls ", "python", "bash", "git ", "cat ", "source ", "export ", "claude", "./activate")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
