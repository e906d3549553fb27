"""Word lists, patterns and constants that results depend on, in natural order."""

# Spellings that stand for one attribute name.
SPELLINGS = {"favourite": "favorite", "neighbourhood": "neighborhood"}
MAX_NAME = 48
THIRD_PARTY = "other_"

# Attribute classes and the names that mean them.
CLASSES = {
    "phone_number": "phone mobile cell cellphone telephone number whatsapp phone_number mobile_number cell_number contact_number tel",
    "email_address": "email e_mail mail email_address",
    "career": "job work title job_title role position employer company career profession workplace",
    "location": "home address city location apartment house flat neighborhood hometown residence place postcode street",
    "pet": "dog cat puppy kitten pet animal hamster rabbit parrot bird fish",
    "allergy": "allergy allergic allergies",
    "birthday": "birthday birthdate dob date_of_birth",
    "credential": "api_key token password secret credential passphrase pin",
    "name": "name preferred_name nickname full_name",
    "emergency_contact": "emergency_contact",
    "routine": "routine schedule",
    "url": "url website site link",
    "ip_address": "ip ip_address",
}
SINGLE_VALUED = "phone_number email_address location career credential emergency_contact birthday name url ip_address routine"
CREDENTIAL_WORDS = "key secret token auth password credential"

# Words before, after and inside an attribute name.
REVISION_WORDS = "new old current latest previous original former updated recent own daily usual go_to"
KEPT_WORDS = "favorite work personal home first second third primary secondary main backup spare other little big elder younger left right weekday weekend emergency"
FUNCTION_WORDS = "the a an of from for to in on at with and or by as that this some any"
TAIL_ADVERBS = "just only really actually ever back then now today currently again still anymore recently originally previously formerly initially before earlier lately nowadays yet already"
EMPTY_HEADS = "day time life week morning evening thing question plan idea point turn problem guess one stuff rule update news way bit lot part kind sort note reason story self"

# Shapes and frames that reveal a class, in the order in which they are tried.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"https?://\S+"
IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
PHONE = r"(?<![\w-])\+?\d[\d\s().-]{6,}\d(?![\w-])"
PHONE_DIGITS = 8
PHONE_CUE = r"\b(phone|mobile|cell|cellphone|telephone|whatsapp|tel|number|line|sim)\b"
STRUCTURE = (
    ("emergency_contact", r"\bemergency contact\b"),
    ("credential", r"\b(api[\s_-]?key|secret[\s_-]?key|password|passcode|passphrase|access[\s_-]?token|auth[\s_-]?token|bearer token|jwt|pin code|private key)\b"),
    ("email_address", EMAIL),
    ("url", URL),
    ("ip_address", IP),
    ("phone_number", PHONE),
    ("birthday", r"\b(birthday|born on|date of birth|dob)\b"),
    ("allergy", r"\b(allergic|allerg(?:y|ies))\b"),
    ("location", r"\b(?:i|we)(?:'m|'ve|'d| am| have| has| are| was| were| will| had)?\s+(?:just |finally |officially |recently |now )*(?:live|living|lives|stay|staying|moved|moving|move|relocated|relocating)\b|\bmy (?:home |new |current |old |previous )?address\b|\b(?:new|current|old|previous) address\b|\b(?:based in|hometown|neighborhood)\b"),
    ("career", r"\b(?:i|we)(?:'m|'ve| am| have| are| was| were)?\s+(?:just |finally |now )*(?:work|works|working|joined|hired|promoted)\b|\bjob title\b|\bmy (?:new |current |old )?(?:title|role|position|employer|company)\b|\b(?:my )?(?:role|title|position) is\b|\bpromoted to\b|\bprofession\b"),
    ("name", r"\b(my name is|call me|i go by|everyone calls me)\b"),
)
CASED_SHAPES = "email_address url ip_address"
FRAMES = "location career name allergy birthday routine emergency_contact"

# Possessives and the slots that they open.
CONTRACTIONS = "it|he|she|that|there|what|who|here|let|one|how|where|when|why"
POSSESSIVE = r"(?P<poss>\b(?:my|our|his|her|their)\b|\b(?!(?:" + CONTRACTIONS + r")'s\b)[a-zÀ-ɏ]+'s)"
OWN_POSSESSIVES = "my our your"
SLOT_NAMED = POSSESSIVE + r"\s+(?P<slot>[a-z][a-z'\- ]{1,40}?)'s name is"
SLOT_IS = POSSESSIVE + r"\s+(?P<slot>[a-z][a-z'\- ]{1,64}?)\s+(?:is|are|was|were|will be|has been|as|=|:)\s"
SLOT_CHANGED = r"\b(?:changed|change|switched|switch|updated|update|renewed|replaced|got|getting|moved|cancelled|canceled)\s+" + POSSESSIVE + r"\s+(?P<slot>[a-z][a-z'\- ]{1,30}?)(?:\s+(?:is|are|was|were|to|from|and)|[,.;:]|$)"
SLOT_RECENT = r"\b(?:new|current|old|previous|latest|former)\s+(?P<slot>[a-z][a-z'\- ]{1,30}?)(?:\s+(?:is|are|was|were|as of)|[:,.\-]|$)"
SLOT_USED = r"\bi (?:use|drive|own|have|play|prefer|take|wear|ride)\s+(?:a|an|the|my)?\s*(?P<slot>[a-z][a-z'\- ]{1,40}?)(?:\s+(?:named|called|is|that|which)|[,.]|$)"
ROUTINE = r"\b(?:every|each) (?:morning|evening|night|day|week|weekend|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
INNER_POSSESSIVE = r"^(?P<lead>.*?)\b(?P<owner>[a-zÀ-ɏ]+)'s\s+(?P<attr>\S.*)$"
NAME_TOKEN = r"\b[A-Z][A-Za-zÀ-ɏ'’-]*"
SENTENCE_BREAKS = ".!?;:\n—-\"'“(["

# Whose fact, and whose question.
FIRST_PERSON = r"\b(my|mine|i|i'm|im|i've|me|we|our|us)\b"
OTHERS_POSSESSIVE = r"\b(?!my\b|our\b|your\b)(?!(?:" + CONTRACTIONS + r")'s\b)[a-zÀ-ɏ]+'s\b|\b(?:his|her|their)\b"
PRONOUN_LED = r"^(he|she|it|they|his|her|its|their|that)\b"
OWN = r"\b(?:my|our)\b"
PERSONAL_WORDS = "my mine myself i me im our ours your yours"
PERSONAL_PHRASES = ("emergency contact", "who am i", "remind me", "do i ", "did i ", "am i ", "was i ", "have i ", "i'm", "i've")
PERSONAL_SOURCES = "chat_session chat user_input cli proxy api rest_api mcp_client mcp"
NAME_VALUE = r"\b(?:my name is|call me|i go by|everyone calls me)\s+(?P<value>[^.,;!?]{1,60})"
NAME_STOP = "the a an just only actually really still mr mrs ms dr prof sir madam"

# What a question asks for: slots in the order in which they count, phrases, words.
ASKED_WHAT_USED = r"\bwhat (?P<slot>[a-z][a-z'\- ]{1,40}?) (?:do i|does (?:he|she|they|[a-zÀ-ɏ]+)) (?:use|have|has|drive|drives|ride|rides|play|plays|own|owns)"
ASKED_ABOUT = r"\b(?:about|of)\s+" + POSSESSIVE + r"\s+(?P<slot>[a-z][a-z'\- ]{1,40}?)(?:\?|$|[,.])"
ASKED_OWN = r"\b(?:what|which|who|where|when|how)\b.*?" + POSSESSIVE + r"\s+(?P<slot>[a-z][a-z'\- ]{1,64}?)(?:\?|$|\s+(?:is|was|are|do|does|did|now|currently|originally|these days|again))"
ASKED_WHICH = r"\b(?:what|which)\s+(?P<slot>[a-z][a-z'\- ]{1,40}?)\s+(?:should|do|does|did|am|are|is|was|were|will|would|have|has)\b"
ASKED_PHRASES = (
    ("emergency_contact", ("emergency contact",)),
    ("credential", ("api key", "access token", "auth token", "secret key", "private key")),
    ("birthday", ("date of birth",)),
    ("name", ("my name", "who am i", "what do i go by", "call me")),
)
ASKED_WORDS = (
    ("phone_number", "phone mobile cell cellphone telephone number whatsapp"),
    ("email_address", "email mail"),
    ("allergy", "allergic allergy allergies"),
    ("birthday", "birthday born birthdate dob"),
    ("pet", "pet pets dog dogs cat cats animal animals"),
    ("credential", "credential credentials password token passphrase"),
    ("location", "live living address city neighborhood hometown reside"),
    ("career", "work job career company employer employed profession title role position"),
    ("routine", "routine schedule"),
    ("url", "website url"),
)

# Cues of time in a question, and markers of a change in a statement.
TIME_CUES = ("current", "currently", "now", "latest", "newest", "updated", "new", "today", "original", "originally", "first", "previous", "previously", "old", "before", "used to", "earlier", "recent", "recently", "these days", "at the moment", "right now", "nowadays", "anymore", "no longer", "instead of", "switched", "since then", "back then", "still", "again")
CHANGE_MARKERS = ("changed", "change", "changing", "switched", "switch", "switching", "updated", "update", "moved", "moving", "renamed", "replaced", "replacing", "cancelled", "canceled", "now", "new", "instead", "as of", "from now on", "these days", "no longer", "latest", "finally", "again", "started", "rescheduled", "reschedule", "upgraded", "upgrade", "downgraded", "swapped", "swap", "transferred", "reassigned", "relocated", "renewed", "superseded", "supersedes")
PAST_FRAME = r"\b(?:was|were|did|had|used to)\b"
ANTERIOR_STRONG = r"\b(?:original|originally|previous|previously|former|formerly|initially|prior|preceding|beforehand)\b|\bused to\b|\bback then\b|\bat first\b|\bto begin with\b|\bto start with\b|\bno longer\b"
ANTERIOR_WEAK = r"\b(?:first|old|older|last|past|earlier|before)\b|\buse to\b"
IMMEDIATE = r"\b(?:previous|previously|prior|preceding)\b|\b(?:just|immediately|right|directly)\s+(?:before|prior)\b|\bthe one (?:just |immediately |right )?before\b|\bbefore (?:the |this |that |my )?(?:one|current|present|latest|newest|last)\b"
INITIAL_STRONG = r"\b(?:original|originally|initially)\b|\bat first\b|\bto begin with\b|\bto start with\b|\bvery first\b"
INITIAL_WEAK = r"\bfirst\b|\bto start with\b|\bstarted (?:out |off )?with\b"
EXPLICIT_HISTORY = "historical oldest previous"
EXPLICIT_PRESENT = "present newest latest now"

# Ranking weights.
INTENT_BOOST = 0.25
GROUP_HOIST = 0.25
REVISION_LEAD = 0.60
GROUP_FLOOR = 0.06
WINDOW_DELTA = 0.16
WINDOW_MAX = 4
WINDOW_SIM = 0.60
INTENT_MARGIN = 0.15
LEAD_STEP = 1e-6
FORGET_FLOOR = 0.42

# Chunking.
MAX_WORDS = 500
MAX_DENSE_CHARS = 1500
OVERLAP_WORDS = 40
OVERLAP_DENSE_CHARS = 120
DENSE_SHARE = 0.2
DENSE_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
WINDOW_LINES = 50
WINDOW_OVERLAP = 10
JOIN_WORDS = 200

# Decomposition of questions.
CLAUSE_SPLIT = r"(?:,\s*|\s+)and\s+(?=(?:how|what|why|where|when|which|who|explain|describe|does|can|could|is|are)\b)|(?:,\s*|\s+)also\s+(?=(?:how|what|why|where|when|which|who|explain|describe|does|can|could|is|are)\b)|\b(?:also|plus|additionally)\b\s*[:,]?\s*"
LIST_QUESTION = r"^(what\s+is|what\s+are|explain|describe|tell\s+me\s+about|how\s+does|how\s+do)\s+(.+)$"
MAX_CLAUSES = 8

# The write gate: openers, cues, directives, weights and ranges of the features.
OPEN_QUESTION = "who whom whose what which when where why how is are was were am do does did done can could will would shall should may might must have has had"
OPEN_REQUEST = "tell write give explain help make show find check translate summarise summarize draft list suggest recommend compare fix calculate convert describe rewrite generate create send search look teach define rank rate pick choose remind"
OPEN_ACK = "ok okay kk yes yeah yep yup no nope nah sure right true exactly agreed fine alright indeed thanks thank thx ta cheers please sorry congrats congratulations haha hahaha hehe heh lol lmao rofl wow oh ah ahh ugh hmm hm huh eh hi hello hey yo bye goodbye night morning evening afternoon nice cool great awesome lovely perfect amazing brilliant well anyway honestly seriously really exactly god lord"
CALENDAR = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun today tomorrow yesterday tonight"
REMEMBER = r"(?:^|[.!?;]\s+|\bplease\s+)(?:remember|note|keep in mind|make a note|take note|write (?:this|that) down|save (?:this|that)|store (?:this|that))\b|\bremember (?:that|this|to)\b|\bnote that\b|\bkeep (?:this|that|it) in mind\b|\bfor the record\b|\b(?:don'?t|do not) forget\b"
FORGET = r"\bforget (?:that|it|this|what)\b|\b(?:don'?t|do not) (?:remember|save|store|record|keep) (?:that|this|it)\b|\b(?:delete|ignore|disregard|scratch) (?:that|this|it)\b|\bnever ?mind\b"
SHORT_FACT = r"\bmy [a-z][\w'\-]*(?:[ \-][a-z][\w'\-]*)? (?:is|are|was|were)\b|\bi(?:'m| am) (?:allergic|intolerant) to\b|\bi(?:'m| am) (?:based in|originally from|from) [A-Z]|\bi (?:live|work|study|drive|own|rent|speak|moved|graduated)\b|\bi (?:don'?t|do not|never|always) (?:eat|drink|take|use|drive|work)\b"
NOT_A_FACT = r"\bi (?:have|need|want|had) to\b"
SHORT_FACT_WORDS = 20
GATE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
GATE_URL = r"https?://\S+|\bwww\.\S+\b"
LONG_NUMBER = r"\d[\d\s.\-()]{5,}\d"
YEAR = r"\b(?:19|20)\d{2}\b"
NUMERIC_DATE = r"\b\d{1,2}[/.\-]\d{1,2}(?:[/.\-]\d{2,4})?\b"
CLOCK = r"\b\d{1,2}\s?[:h]\s?\d{2}\b|\b\d{1,2}\s?(?:am|pm)\b"
CURRENCY = r"[$€£¥₦₹₽₩₪₫₱฿]|\b(?:usd|eur|gbp|jpy|ngn|brl|inr|cad|aud|chf|cny|krw|mxn)\b"
UNIT = r"\b\d+(?:[.,]\d+)?\s?(?:mg|mcg|kg|g|ml|cl|l|km|cm|mm|m|kb|mb|gb|tb|hz|%|units?|hrs?|hours?|mins?|minutes?|secs?|seconds?|days?|weeks?|months?|years?)\b"
SELF_PREDICATE = r"\b(?:i am|i'm|im|i was|i work|i live|i have|i've|i use|i take|i need|i moved|we are|we're|we have|we've|we moved)\b|\bmy \w+(?:'s)? (?:is|are|was|were|will be|became)\b|\bis my\b|\bare my\b"
FIRST_WORDS = "i i'm im me my mine myself we us our ours we're we've i've i'll"
SECOND_WORDS = "you your yours yourself you're youre u ur"
# name, weight, least and greatest value of a feature
GATE = (
    ("log_chars", 7.06385994, 0.923024, 1.242922),
    ("log_tokens", 6.79860258, 0.599146, 0.890869),
    ("avg_token_len", 3.26087260, 0.0, 0.75),
    ("has_question_mark", -1.50079107, 0.0, 1.0),
    ("ends_question", -0.11409295, 0.0, 1.0),
    ("opens_interrogative", -1.39925086, 0.0, 1.0),
    ("request_cue", -2.03127432, 0.0, 1.0),
    ("second_person_ratio", -0.16632578, 0.0, 0.222222),
    ("first_person_ratio", -2.51185846, 0.0, 0.25),
    ("possessive_my_ratio", 7.04880714, 0.0, 0.125),
    ("self_predicate", 0.67084736, 0.0, 1.0),
    ("digit_ratio", 18.76884270, 0.0, 0.139535),
    ("has_long_number", 1.12765396, 0.0, 1.0),
    ("has_email", 2.90146565, 0.0, 1.0),
    ("has_url_or_ip", 0.0, 0.0, 1.0),
    ("has_year_or_date", 0.93030894, 0.0, 1.0),
    ("has_clock_time", 0.51543438, 0.0, 1.0),
    ("has_month_or_weekday", 0.04740350, 0.0, 1.0),
    ("has_currency", 1.07983160, 0.0, 1.0),
    ("has_measure_unit", 1.60502267, 0.0, 1.0),
    ("proper_noun_ratio", 13.18102932, 0.0, 0.424242),
    ("ack_opener", -0.90943617, 0.0, 1.0),
    ("exclamation", 0.57321066, 0.0, 1.0),
)
GATE_BIAS = -14.15579913
GATE_THRESHOLD = 0.6

# The lexical encoder.
ENCODER_WIDTH = 768
TRIGRAM_WEIGHT = 0.35
