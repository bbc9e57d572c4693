"""Word lists and tables that results depend on."""

TECH_WORDS = (
    "kubernetes docker react python postgresql redis elasticsearch terraform graphql lambda spark kafka mongodb nginx pytorch tensorflow "
    "fastapi django flask express nextjs typescript javascript golang rust java scala swift kotlin github gitlab aws gcp azure datadog prometheus grafana"
).split()
TOOL_WORDS = (
    "python rust go java typescript javascript react fastapi docker kubernetes faiss weaviate qdrant redis postgresql mongodb tensorflow pytorch "
    "cuda ollama networkx numpy linux macos git github jupyter aws gcp azure oci"
).split()
FACT_PHRASES = (
    ("my name is", "i am", "i work", "i lead", "i manage", "i use", "i prefer", "i live"),
    ("our team", "our project", "our company", "our product"),
    ("always", "never", "must", "important", "critical", "key", "remember"),
)
LOW_VALUE_PHRASES = (
    ("hmm", "uh", "ok", "okay", "sure", "thanks", "thank you", "got it", "yes", "no", "yep", "nope"),
    ("hello", "hi", "hey", "bye", "goodbye", "see you"),
)
RECENCY = "current latest recent now today updated newest last currently presently ongoing active".split()
RECENCY_PHRASES = ("this week", "this month", "at the moment")
PRECISION = "exact specific precisely details configuration config number value parameter setting verbatim literal".split()
PRECISION_PHRASES = ("how much", "how many", "what was the")
BREADTH = "everything all overview summary background history context".split()
BREADTH_PHRASES = ("tell me about", "what do you know")
PROFILE_TECH = (
    "function class method api database query model vector algorithm architecture latency throughput config deploy cluster node index schema pipeline endpoint"
).split()
PHATIC_STARTS = (
    "hey hi hello thanks ok okay sure yeah yep wow cool nice great awesome definitely totally absolutely right exactly haha lol oh ah hmm well so anyway bye"
).split()
QUERY_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can what which who when where how why i you my"
).split()
ENTITY_STOP_WORDS = (
    "The This That These Those What When Where Which How Why But And For Not You All Can Had Her Was One Our Out Are Has His Its Let Say She Too Use "
    "Also Each Then They Been Call Come Find First Get Have Here Just Know Like Long Look Make Many Most Much Must Name New Now Old Only Over Such Take "
    "Than Them Very Well With Would Could Should May Some After Before Between Every Still From Into Will About Above Below Since While Being Both Does "
    "Done Down Even Given Good Great Keep Last Left Little Might Never Next Other Right Same Several Small Think Three Under Until World However Instead "
    "Because Although Whether"
).split()
EXCLUSIVE_PREDICATES = "works_at employed_by lives_in located_in is_a role_is reports_to leads uses".split()
NEGATIONS = {"works_on": "stopped_working_on", "works_at": "left", "leads": "stepped_down_from", "uses": "stopped_using", "researches": "abandoned"}
PREDICATE_TIERS = {
    "identity": "is_a named born_in".split(),
    "professional": "works_at employed_by leads manages reports_to role_is".split(),
    "project": "works_on uses researches created part_of".split(),
    "ephemeral": "prefers likes located_in mentioned discussed".split(),
}
TYPE_TIERS = {"professional": ["person", "org"], "project": ["tool", "project", "concept"], "ephemeral": ["location"]}
TIER_RATES = {"identity": 0.001, "professional": 0.005, "project": 0.01, "ephemeral": 0.05}
PROFILE_LABELS = {
    "response_depth": ((0.9, "deep/technical"), (0.7, "detailed"), (0.3, "moderate"), (0.0, "brief")),
    "formality": ((0.8, "formal"), (0.6, "semi-formal"), (0.3, "casual"), (0.0, "very casual")),
    "domain_expertise": ((0.8, "expert"), (0.6, "advanced"), (0.3, "intermediate"), (0.0, "beginner")),
    "verbosity_preference": ((0.8, "verbose"), (0.6, "moderate"), (0.3, "concise"), (0.0, "terse")),
}
RERANK_STOP_WORDS = (
    "what is the a an on in at to of for and or my me i do does did how why when where which who tell about with from that this are"
).split()
ANCHOR_SKIP_WORDS = (
    "what when where which who how why the this that from with about tell does did has have can could would should will may might"
).split()
PHATIC_OPENINGS = (
    "hey|hi|hello|thanks|thank you|ok|okay|sure|yeah|yep|wow|cool|nice|great|awesome|definitely|totally|absolutely|right|exactly|"
    "haha|lol|oh|ah|hmm|well|so|anyway|bye|see you|take care"
)
INFO_PATTERN = (
    r"\b(?:\d+\s*(?:percent|%|dollars?|months?|years?|weeks?|days?|hours?|minutes?|k|K|million|billion|mg|kg|lb|miles?|km))\b"
    r"|(?:\b\d{1,2}\s+\w+\s+\d{4}\b)|(?:\b\d{4}-\d{2}-\d{2}\b)|(?:^I\s+(?:work|left|joined|started|moved|quit|got|decided|plan))"
)
PREDICATE_FORMS = {
    "working_on": "works_on", "employed_at": "works_at", "employed_by": "works_at", "leading": "leads", "managing": "manages", "using": "uses", "researching": "researches", "is_an": "is_a",
    "based_in": "located_in", "member_of": "part_of", "built": "created", "likes": "prefers", "quit": "left",
}
