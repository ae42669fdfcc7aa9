"""Fixed values of the rule-based task text enrichment.

Everything in this module is a fixed value that must equal the app's rules
for results to agree: patterns, keyword tables, canned texts. Order matters
everywhere: the first matching rule wins. Matching is on the lower-cased
text by plain substring unless a pattern is given.

Patterns are JavaScript regexes restated in the common subset of Java regex
and RE2: ``(?i)`` for the ``i`` flag and the JS white-space class in place
of ``\\s`` (see ``tidemark.functions.text.JS_WS``).
"""

from __future__ import annotations

from tidemark.functions.text import JS_WS

_S = JS_WS  # JavaScript \s

# ---- fixed values: extraction patterns (smart parse) ----------------------
DATE_PATTERNS = [
    r"(?i)\b(today|tomorrow|next week|next month)\b",
    r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b(\d{1,2}/\d{1,2}/?\d{0,4})\b",
    rf"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december){_S}+\d{{1,2}}\b",
]
TIME_PATTERNS = [
    rf"(?i)\b(\d{{1,2}}:\d{{2}}{_S}?(am|pm)?)\b",
    r"(?i)\b(morning|afternoon|evening|night)\b",
]
PRIORITY_HIGH_PATTERN = r"(?i)\b(urgent|asap|important|high priority|critical)\b"
PRIORITY_LOW_PATTERN = r"(?i)\b(low priority|when possible|eventually)\b"
PEOPLE_PATTERNS = [
    rf"\bwith{_S}+([A-Z][a-z]+(?:{_S}+[A-Z][a-z]+)*)\b",
    rf"\b([A-Z][a-z]+(?:{_S}+[A-Z][a-z]+)*){_S}+and{_S}+me\b",
]
LEADING_VERB_PATTERN = rf"(?i)\A(plan|schedule|organize|prepare|do|complete){_S}+"

# ---- fixed values: keyword tables -----------------------------------------
CATEGORY_KEYWORDS = [
    ("work", ["meeting", "project", "presentation", "email", "call", "deadline"]),
    ("personal", ["family", "friend", "home", "health", "exercise", "hobby"]),
    ("shopping", ["buy", "purchase", "shop", "grocery", "store"]),
    ("health", ["doctor", "appointment", "exercise", "gym", "medicine"]),
    ("finance", ["pay", "bill", "budget", "bank", "tax", "money"]),
]
DEFAULT_CATEGORY = "general"

SMART_TAGS = [
    ("urgent", ["urgent", "asap"]),
    ("meeting", ["meeting", "call"]),
    ("communication", ["email", "message"]),
    ("shopping", ["buy", "purchase"]),
]

DURATION_KEYWORDS = [
    ("15 minutes", ["quick", "brief", "short"]),
    ("30 minutes", ["call", "standup", "check-in"]),
    ("1 hour", ["meeting", "appointment", "review"]),
    ("2 hours", ["project work", "deep work", "analysis"]),
    ("4 hours", ["workshop", "training", "major task"]),
    ("1 day", ["project", "research", "planning"]),
]
DEFAULT_DURATION = "30 minutes"

# (keywords, suggestions): checked on the cleaned task name
SUGGESTION_RULES = [
    (["call", "phone", "contact"],
     ["Find their contact information", "Prepare talking points", "Choose appropriate time zone",
      "Set follow-up reminder"]),
    (["meeting", "interview"],
     ["Send calendar invite", "Prepare agenda", "Research attendees", "Book meeting room"]),
    (["email", "message", "write"],
     ["Draft key points", "Review recipient details", "Set send time", "Prepare attachments"]),
    (["buy", "purchase", "shop"],
     ["Check budget availability", "Compare prices online", "Read reviews", "Check return policy"]),
    (["plan", "organize", "prepare"],
     ["Create detailed timeline", "List required resources", "Identify key stakeholders", "Set milestones"]),
    (["exercise", "workout", "gym"],
     ["Pack gym clothes", "Plan workout routine", "Set hydration reminder", "Track progress"]),
    (["doctor", "appointment", "medical"],
     ["Gather insurance information", "Prepare questions to ask", "Bring previous records",
      "Set arrival reminder"]),
    (["travel", "trip", "flight"],
     ["Check travel documents", "Pack essential items", "Confirm reservations", "Set departure reminder"]),
    (["study", "learn", "course"],
     ["Gather study materials", "Find quiet study space", "Set learning goals", "Schedule practice time"]),
    (["presentation", "present", "demo"],
     ["Create slide outline", "Practice delivery", "Test all technology", "Prepare for questions"]),
]
CATEGORY_FALLBACK_SUGGESTIONS = [
    ("work", ["Block focus time", "Notify relevant stakeholders", "Prepare materials", "Set deadline reminder"]),
    ("personal", ["Set location reminder", "Check weather forecast", "Inform family/friends",
                  "Prepare backup plan"]),
    ("health", ["Set recurring reminder", "Research preparation steps", "Contact healthcare provider",
                "Track in health app"]),
    ("finance", ["Check budget impact", "Review account balances", "Set payment reminder", "Save receipts"]),
    ("home", ["Check needed supplies", "Clear schedule time", "Prepare workspace", "Set completion reminder"]),
]
GENERIC_SUGGESTIONS = ["Break into smaller steps", "Set completion deadline", "Gather needed resources",
                       "Plan optimal timing"]

# (prefix, category, tags, priority, duration); None = take the default
QUICK_PREFIXES = [
    ("buy ", "shopping", ["shopping"], "medium", None),
    ("call ", "personal", ["communication"], "medium", None),
    ("email ", "work", ["communication", "work"], "medium", None),
    ("meeting ", "work", ["meeting", "work"], "high", "1 hour"),
    ("urgent ", None, ["urgent"], "high", None),
    ("doctor ", "health", ["health", "appointment"], "high", None),
    ("gym ", "health", ["exercise", "health"], "medium", "1 hour"),
]
QUICK_CONFIDENCE = 0.9

# confidence: base, then additions in this order
CONFIDENCE_BASE = 0.5
CONFIDENCE_DATE = 0.2
CONFIDENCE_TIME = 0.1
CONFIDENCE_PEOPLE = 0.1
CONFIDENCE_LONG = 0.1
CONFIDENCE_LONG_OVER = 10

# ---- fixed values: breakdown ------------------------------------------------
# (key, [(task, priority, estimatedTime), ...])
BREAKDOWN_TEMPLATES = [
    ("organize team retreat", [
        ("Define budget and constraints", "high", "1 hour"),
        ("Research and book venue", "high", "3 hours"),
        ("Plan agenda and activities", "medium", "2 hours"),
        ("Send invitations to team", "medium", "30 minutes"),
        ("Arrange catering/meals", "medium", "1 hour"),
        ("Prepare materials and supplies", "low", "1 hour"),
    ]),
    ("launch product", [
        ("Finalize product features", "high", "1 week"),
        ("Complete testing and QA", "high", "3 days"),
        ("Prepare marketing materials", "high", "2 days"),
        ("Set up analytics and tracking", "medium", "4 hours"),
        ("Plan launch event/announcement", "medium", "1 day"),
        ("Monitor initial user feedback", "low", "Ongoing"),
    ]),
]
# generic steps: (prefix before the task text, priority, estimatedTime)
GENERIC_BREAKDOWN = [
    ("Research and plan for: ", "medium", "30 minutes"),
    ("Execute main work for: ", "high", "1 hour"),
    ("Review and finalize: ", "low", "15 minutes"),
]
GENERIC_BREAKDOWN_NOTE = "AI-generated breakdown based on task analysis"
TOTAL_TIME_LONG = "1-2 days"
TOTAL_TIME_SHORT = "2-4 hours"
TOTAL_TIME_STEPS_OVER = 3

# ---- fixed values: prioritisation -------------------------------------------
PRIORITY_KEYWORDS = [
    ("urgent", ["urgent", "asap", "deadline", "due", "critical", "emergency"]),
    ("high", ["important", "meeting", "presentation", "client", "boss", "interview"]),
    ("medium", ["plan", "prepare", "research", "review", "organize"]),
    ("low", ["someday", "maybe", "when possible", "eventually", "nice to have"]),
]
PRIORITY_REASON_FORMAT = 'Marked as %s priority due to keyword: "%s"'
PRIORITY_REASON_DEFAULT = "Default medium priority assigned"

# ---- fixed values: contextual suggestions -----------------------------------
TOPIC_SUGGESTIONS = [
    ("blog post", ["Research trending topics in your niche", "Create an outline with key points",
                   "Find relevant images and graphics", "Optimize for SEO keywords",
                   "Schedule social media promotion"]),
    ("meeting", ["Prepare agenda items", "Send calendar invites", "Book conference room",
                 "Prepare presentation materials", "Share pre-meeting documents"]),
    ("project", ["Define project scope and goals", "Identify key stakeholders", "Create project timeline",
                 "Set up collaboration tools", "Plan regular check-ins"]),
]
GENERIC_TOPIC_SUGGESTIONS = ["Break this down into smaller steps", "Set a deadline for completion",
                             "Identify resources you might need", "Consider who else might be involved"]
RELATED_ACTIONS = ["Add to calendar", "Set reminder", "Create checklist", "Share with team"]

# ---- fixed values: scheduling -----------------------------------------------
BEST_TIME_RULES = [
    (["meeting", "call"], "10:00 AM - Best for focused discussions"),
    (["creative", "design"], "9:00 AM - Peak creative hours"),
]
BEST_TIME_DEFAULT = "2:00 PM - Good for general tasks"
PREP_RULES = [
    (["presentation"], "1 hour preparation time"),
    (["meeting"], "15 minutes preparation time"),
]
PREP_DEFAULT = "5 minutes preparation time"
REMINDERS = ["1 day before", "1 hour before", "15 minutes before"]
ALTERNATIVES = ["Tomorrow morning", "Next week", "End of day today"]
BUFFER_RULES = [(["meeting"], "15 minutes before and after")]
BUFFER_DEFAULT = "5 minutes buffer"
CONFLICT_BUSY = "Schedule appears busy - consider rescheduling"
CONFLICT_FREE = "No scheduling conflicts detected"
CONFLICT_OVER = 5

# ---- fixed values: features and ids -----------------------------------------
FEATURES = ["smart-parse", "task-breakdown", "smart-prioritize", "contextual-suggestions",
            "smart-scheduling"]
DEFAULT_FEATURE = "smart-parse"
PUSH_CHARS = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
PUSH_RANDOM_PART = "-" * 12
CACHE_TTL_SECONDS = 5 * 60

# prompt heads per feature; the body after the text is the JSON shape asked for
PROMPT_PARSE = ('Parse: "{text}"\n\nReturn JSON:\n{{\n  "taskName": "cleaned task name",\n'
                '  "date": "extracted date or null",\n  "time": "extracted time or null", \n'
                '  "priority": "high/medium/low",\n  "people": ["names"],\n'
                '  "category": "work/personal/health/etc",\n  "tags": ["tags"],\n'
                '  "estimatedDuration": "duration",\n  "confidence": 0.8,\n'
                '  "suggestions": ["tip1", "tip2"]\n}}')
PROMPT_BREAKDOWN = ('Break down: "{text}"\n\nReturn JSON:\n{{\n'
                    '  "breakdown": [{{"task": "step", "priority": "high/med/low", "estimatedTime": "30min"}}],\n'
                    '  "totalEstimatedTime": "2 hours",\n  "recommendations": ["tip1", "tip2"]\n}}')
PROMPT_PRIORITIZE = ('Prioritize: {text}\n\nReturn JSON:\n{{\n'
                     '  "prioritizedTasks": [{{"task": "name", "aiPriority": "high", "reasoning": "why"}}],\n'
                     '  "insights": ["insight1", "insight2"]\n}}')
PROMPT_SUGGEST = ('Suggest for: "{text}"\n\nReturn JSON:\n{{\n'
                  '  "suggestions": ["suggestion1", "suggestion2"],\n'
                  '  "relatedActions": ["action1", "action2"],\n  "bestPractices": ["tip1", "tip2"]\n}}')
PROMPT_SCHEDULE = ('Schedule: "{text}"\n\nReturn JSON:\n{{\n  "optimalTime": "best time",\n'
                   '  "duration": "estimated duration",\n  "preparation": "prep time",\n'
                   '  "alternatives": ["alt1", "alt2"]\n}}')
PROMPTS = {
    "smart-parse": PROMPT_PARSE,
    "task-breakdown": PROMPT_BREAKDOWN,
    "smart-prioritize": PROMPT_PRIORITIZE,
    "contextual-suggestions": PROMPT_SUGGEST,
    "smart-scheduling": PROMPT_SCHEDULE,
}

# Fixed value: the chat's system message; the context text below follows it.
SYSTEM_PROMPT = """You are a helpful AI assistant integrated into a todo/productivity app. Help users with:
      - Task planning and organization
      - Productivity tips and strategies  
      - Time management advice
      - Breaking down complex projects
      - Research and information for their tasks
      - General questions and assistance
      
      Be concise, practical, and focused on helping users be more productive. If they ask about specific topics for research or work, provide accurate and up-to-date information."""

# chat context text
CONTEXT_LINE = "- {task} (Priority: {priority}{due})"
CONTEXT_DUE = ", Due: {date}"
CONTEXT_HEADER = "\n\nCURRENT USER TASKS ({n} active tasks):\n"
CONTEXT_FOOTER = ("\n\nUse this context to provide relevant assistance with their tasks, suggest "
                  "improvements, help with prioritization, or answer questions about their workload.")
