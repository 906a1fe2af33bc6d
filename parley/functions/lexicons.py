"""Word lists, phrases and patterns that the scores are defined by."""

from __future__ import annotations

# Modal verbs.
MODALS = ["may", "might", "could", "would", "should", "can", "will"]

# Qualifiers.
QUALIFIERS = [
    "approximately", "roughly", "about", "around", "nearly", "somewhat", "fairly", "rather", "generally", "typically", "usually", "often",
    "occasionally", "sometimes", "largely", "mostly", "primarily", "potentially", "possibly", "likely", "unlikely", "probably",
    "perhaps", "maybe", "conceivably", "uncertain", "cautious", "cautiously optimistic", "depending on", "subject to",
]

# Phrases of uncertainty.
UNCERTAINTY = [
    "we believe", "we expect", "we anticipate", "we estimate", "we think", "we feel", "we hope", "we project",
    "it is difficult", "it is hard to say", "it is too early", "too early to tell", "too early to say",
    "we are evaluating", "we continue to monitor", "we continue to evaluate", "we are monitoring", "we are assessing", "we are reviewing",
    "cannot comment", "can't comment", "no comment", "not in a position", "we remain cautious", "cautiously optimistic", "proceed with caution",
    "depending on", "subject to", "contingent on", "assuming that", "if conditions", "if the market", "if demand", "if macroeconomic",
    "uncertain", "uncertainty", "unpredictable", "volatility", "range of outcomes", "remains to be seen", "yet to be determined",
    "we will see", "hard to predict", "difficult to predict", "it is difficult to say",
]

# Phrases of deflection.
DEFLECTION = [
    "i can't comment", "cannot comment on that", "it is too early", "it's too early", "we are monitoring", "we continue to evaluate",
    "we will provide information later", "we will update you", "we are focused on the long term", "long-term value",
    "as you know", "the important thing is", "i think the key point is", "what i would say is", "let me step back", "the bigger picture",
    "we are working through", "we are working on", "we are navigating", "we will cross that bridge", "we will take it one quarter at a time",
    "we are not providing guidance", "we are not in a position to provide", "we are not prepared to", "we prefer not to", "cannot comment",
]

# Negative words of the word-ratio baseline.
NEGATIVE = """
abandon abandoned abandonment abnormal absence absent abuse adverse adversely adversity alarm alarming allegation bankrupt bankruptcy
below breach burden challenge challenging claim complaint concern concerning conflict controversy costly crisis critical damage decline
declining default deficiency deficit delay deteriorate deteriorating difficult difficulty disappoint disappointing disappointment dispute
disrupt disruption doubt downturn drop eliminate error exceed excessive fail failure fall falling fault fear fraud harm headwind
headwinds higher impair impairment inability inadequate incident inferior inflation insufficient investigat issue issues lack late
limitation limited loss losses lower material miss misstatement negative negligence nonperforming obstacle overrun penalty poor
pressure problem problems reduce reduction regulatory remediation risk risks shortage significant slow slowdown slowing struggle
substantial suffer suffering uncertainty unexpected unfavorable unfavorably volatility vulnerability warn warning weak weaken weakness
worse worsen worsening writeoff writedown
""".split()

# Words that say nothing about a topic.
TOPIC_STOP = [
    "that", "this", "with", "from", "have", "been", "will", "your", "what", "when", "where", "which", "would", "could", "should",
    "about", "their", "there", "they", "were", "then", "than", "into", "also", "just", "because", "more", "some", "like",
]

# English function words left out before term weighting; a list of our own, stated in the README.
STOP_WORDS = """
a an the and or but if while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very can will just should now i me my we our you your he him his she her it its they them their what which who whom
this that these those am is are was were be been being have has had do does did doing would could may might must shall
""".split()

# Patterns of direct answers.
DIRECT = [
    r"\b\d+[\.,]?\d*\s*(?:percent|%|million|billion|billion dollars|dollars|bps|basis points)\b",
    r"\b(?:specifically|exactly|precisely|the answer is|yes|no|we did|we will|we have)\b",
    r"\b(?:our guidance is|our target is|we expect)\s+\d",
    r"\byes\b",
    r"\bno\b",
    r"\bwe achieved\b",
    r"\bwe reported\b",
    r"\bwe delivered\b",
    r"\bwe completed\b",
    r"\bwe reduced\b",
    r"\bwe increased\b",
    r"\bwe grew\b",
]

# Patterns of deflecting answers.
DEFLECTING = [
    r"\bas you know\b",
    r"\bthe important thing is\b",
    r"\bi think the key (?:point|thing|message) is\b",
    r"\bwhat i would say is\b",
    r"\blet me step back\b",
    r"\bmore broadly\b",
    r"\bthe bigger picture\b",
    r"\bwe are focused on the long[- ]term\b",
    r"\blong[- ]term value\b",
    r"\bwe are not (?:in a position|prepared|able) to\b",
    r"\bwe (?:are not |don't |cannot )(?:comment|provide guidance|discuss)\b",
    r"\bwe will (?:update|provide) (?:you|more information|further details) later\b",
    r"\bwe (?:continue to|are still) (?:evaluate|monitor|assess|review|work through)\b",
    r"\bit (?:is|'s) too early\b",
    r"\bremains to be seen\b",
    r"\bwe are navigating\b",
    r"\bwe are working through\b",
    r"\bwe prefer not to\b",
    r"\bnot in a position to\b",
    r"\btake it one quarter at a time\b",
]

# Patterns of generic language.
GENERIC = [
    r"\blong[- ]term (?:value|growth|shareholder value|strategy)\b",
    r"\bdriving (?:growth|value|profitability|efficiency)\b",
    r"\bremain(?:s)? committed\b",
    r"\bremain(?:s)? focused\b",
    r"\bdeliver(?:ing)? (?:value|results|growth)\b",
    r"\bcreating value\b",
    r"\boptimizing (?:for |our )?(?:performance|growth|efficiency|returns)\b",
    r"\bbest position(?:ed)? to\b",
    r"\bstrongest (?:portfolio|team|position|pipeline)\b",
    r"\bworld[- ]class\b",
    r"\bstrategic (?:priorities|initiatives|investments|transformation)\b",
    r"\bdigital (?:transformation|journey|strategy)\b",
    r"\boperational excellence\b",
    r"\bmomentum\b",
    r"\bexecuting (?:well|on our|against our)\b",
]

# A question that asks for a number, an answer that has one.
ASKS_NUMBER = r"\b(?:how much|how many|what (?:is|was|are|were) the|what (?:percent|percentage|growth|margin|revenue|earnings|guidance)|what (?:number|level|amount|range|target)|quantify|specific(?:ally)?|exact(?:ly)?|\d+)\b"
HAS_NUMBER = r"\b\d+[\.,]?\d*\s*(?:percent|%|million|billion|thousand|bps|basis points|dollars|cents|x|times|quarters|years)?\b"

# Claim topics in order of precedence.
CLAIM_TOPICS = [
    (r"\b(?:gross margin|operating margin|ebitda margin|profit margin|margin expansion|margins)\b", "margin"),
    (r"\b(?:revenue|sales|top[- ]line|turnover|net sales)\b", "revenue"),
    (r"\b(?:eps|earnings per share|net income|operating income|ebitda|profitability)\b", "earnings"),
    (r"\b(?:capex|capital expenditure|capital spending|investments in capacity)\b", "capex"),
    (r"\b(?:debt|leverage|deleveraging|debt reduction|borrowing|credit facility)\b", "debt"),
    (r"\b(?:free cash flow|operating cash flow|cash generation|cash conversion)\b", "cash_flow"),
    (r"\b(?:cost reduction|cost savings|restructuring charges|operating expenses|sg&a)\b", "costs"),
    (r"\b(?:demand|order intake|backlog|order book|bookings|customer demand)\b", "demand"),
    (r"\b(?:market conditions|macroeconomic environment|headwinds|tailwinds|inflation)\b", "market_conditions"),
    (r"\b(?:guidance|forecast|outlook|target|projecting|projected|expect(?:s|ed|ing)? to deliver)\b", "guidance"),
]

# Numbers, directions and boilerplate in claims.
CLAIM_NUMBER = r"(?:\$\s*\d+[\.,]?\d*\s*(?:billion|million|b|m)?|\b\d+[\.,]?\d*\s*(?:percent|%|bps|basis points|cents)\b|\bbetween\s+\d+\s+and\s+\d+\b)"
DIRECTION = r"\b(grow|growth|increase|increasing|increased|higher|accelerat\w*|improv\w*|up|expand\w*|declin\w*|decreas\w*|lower|slow\w*|down|contract\w*|flat|stable)\b"
UP = ["grow", "growth", "increase", "increasing", "increased", "higher", "accelerating", "improve", "improving", "improved", "up", "expand", "expanding", "expansion"]
DOWN = ["decline", "declining", "declined", "decrease", "decreasing", "decreased", "lower", "slowing", "down", "contracting"]
FLAT = ["flat", "stable"]
BOILERPLATE = r"(?:forward[- ]looking statements|safe harbor|sec filings|press release is available|conference call will contain|subject to risks and uncertainties|risk factors detailed|actual results may differ materially|please refer to our form 10[- ]k)"

# Numbers with units, first match in this order: range, basis points, percentage, dollars.
RANGE_PERCENT = r"(?:between\s+(\d+[\.,]?\d*)\s+(?:and|to)\s+(\d+[\.,]?\d*)\s*(?:percent|%)|(\d+[\.,]?\d*)\s*(?:%|percent)?\s*(?:to|-)\s*(\d+[\.,]?\d*)\s*(?:percent|%))"
BASIS_POINTS = r"(\d+[\.,]?\d*)\s*(?:bps|basis points)\b"
PERCENT = r"(\d+[\.,]?\d*)\s*(?:percent\b|%)"
DOLLARS = r"\$\s*(\d+[\.,]?\d*)\s*(billion|million|thousand|b|m|k)?\b"

# Periods, places and metrics in order of precedence.
PERIODS = [
    (r"\b(?:next quarter|q[1-4]\s*(?:outlook|next)|coming quarter)\b", "next_quarter"),
    (r"\b(?:full year|fiscal year|fy\s*\d{2,4}|annual|for the year)\b", "full_year"),
    (r"\b(?:first half|1h|first six months)\b", "first_half"),
    (r"\b(?:second half|2h|back half)\b", "second_half"),
    (r"\b(?:q1|first quarter)\b", "q1"),
    (r"\b(?:q2|second quarter)\b", "q2"),
    (r"\b(?:q3|third quarter)\b", "q3"),
    (r"\b(?:q4|fourth quarter)\b", "q4"),
    (r"\b(?:long[- ]term|three to five years)\b", "long_term"),
    (r"\b(?:current quarter|this quarter)\b", "current_quarter"),
]
PLACES = [
    (r"\b(?:north america|us|united states|domestic)\b", "North America"),
    (r"\b(?:europe|european|emea)\b", "Europe"),
    (r"\b(?:china|chinese)\b", "China"),
    (r"\b(?:asia|asia[- ]pacific|apac)\b", "Asia"),
    (r"\b(?:latin america|latam|brazil)\b", "Latin America"),
    (r"\b(?:global|worldwide|international)\b", "Global"),
]
METRICS = [
    (r"\b(?:revenue growth|sales growth|top[- ]line growth)\b", "revenue_growth"),
    (r"\b(?:gross margin)\b", "gross_margin"),
    (r"\b(?:operating margin|operating profit margin)\b", "operating_margin"),
    (r"\b(?:eps|earnings per share)\b", "eps"),
    (r"\b(?:net income|net profit)\b", "net_income"),
    (r"\b(?:operating income|operating profit)\b", "operating_income"),
    (r"\b(?:capex|capital expenditure|capital spending)\b", "capex"),
    (r"\b(?:free cash flow|fcf)\b", "free_cash_flow"),
    (r"\b(?:debt reduction|debt paydown|leverage)\b", "debt_reduction"),
    (r"\b(?:cost reduction|cost savings)\b", "cost_reduction"),
    (r"\b(?:organic revenue|organic growth)\b", "organic_growth"),
    (r"\b(?:revenue|sales)\b", "revenue"),
]

# Signals of direction in evidence.
POSITIVE = r"\b(grew|growth|increase|increased|higher|improved|strong|surge|beat)\b"
NEGATIVE_SIGNS = r"\b(fell|declined|decreased|lower|missed|weak|below|disappoint|short|cut)\b"

# Words of good tone in the stand-in for a model: those of POSITIVE.
TONE_UP = ["grew", "growth", "increase", "increased", "higher", "improved", "strong", "surge", "beat"]

# Words after which a full stop ends no sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "al", "e.g", "i.e", "cf", "fig", "no", "approx", "est", "inc", "corp", "co",
    "ltd", "llc", "plc", "q1", "q2", "q3", "q4", "h1", "h2", "fy", "ytd", "qoq", "yoy", "bps", "eps", "ebitda", "ebit", "u.s", "u.k", "e.u",
]

# Speakers, titles and cues of the sections of a call.
OPERATORS = ["operator", "moderator", "facilitator"]
EXECUTIVE_TITLE = r"\b(?:chief\s+(?:executive|financial|operating|technology|marketing)|president|chairman|founder|co-founder|director|ceo|cfo|coo|cto|cmo|evp|svp|vp)\b"
ANALYST_TITLE = r"\b(?:analyst|research\s+analyst|equity\s+analyst|(?:head|director)\s+of\s+research)\b"
QUESTION_CUE = r"\b(?:we will now (?:begin|open)|open (?:the )?(?:floor|call) for questions?|our first question|next question|we have time for|caller.*please (?:go ahead|proceed)|please (?:state|provide) your name)\b"
SPEAKER_LABEL = r"(?:^|\n)\s*([A-Z][A-Za-z0-9 ,.\-']{1,50}):\s*"
SECTIONS = ["prepared_remarks", "q_and_a", "opening", "closing", "unknown"]
ROLES = ["executive", "analyst", "operator", "unknown"]
