"""Word lists, phrase lists, names and limits of the style rubric."""

# fixed values: they decide results and must be these, in this order
STOPWORDS = (
    "the a an and or but if then because so of to in on for with by as at from that this these those is are was "
    "were be been being it its they them their we our you your i me my he his she her not no yes do does did can "
    "could would should may might must will just have has had"
).split()
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "yourselves"]
IGNORED_STARTERS = ["i", "we", "you", "the", "a", "an", "this", "that", "it"]
BUZZ = [
    "synergy", "leverage", "unlock", "paradigm", "disrupt", "innovative", "thought leadership", "game-changer",
    "empower", "elevate", "journey", "mission", "vision", "stakeholders", "scalable", "robust", "strategic",
    "amazing", "incredible", "excited to announce", "thrilled to", "grateful for", "honored to", "humble",
    "delighted to share", "proud to",
]
HEDGE = [
    "as an ai", "as a language model", "i cannot", "i'm unable", "i am unable", "i don't have access",
    "cannot provide", "i cannot provide",
]
TRANSITION = [
    "in conclusion", "overall", "to sum up", "moreover", "furthermore", "additionally", "in addition",
    "on the other hand", "as a result", "in summary", "it is important to", "it is worth noting",
    "at the end of the day", "in the meantime", "that said", "in other words", "to be clear", "to put it simply",
    "as such", "with that in mind",
]
TEMPLATE = [
    "here's the thing", "let's dive in", "key takeaways", "tldr", "tl;dr", "in today's world", "i want to share",
    "i'm excited to share", "if you're", "what i learned", "lessons learned", "actionable steps", "in this post",
    "in this thread", "here are", "here's how", "here is how", "step by step",
]
RHETORICAL = [
    "here's what", "here is what", "what this means", "why it matters", "the takeaway", "the bottom line",
    "let that sink in", "read that again", "the lesson", "the reality is", "make no mistake", "it's not about",
    "this isn't about", "the question is",
]
FAMILIES = {"buzz": BUZZ, "hedge": HEDGE, "transition": TRANSITION, "template": TEMPLATE, "rhetorical": RHETORICAL}
FEATURE_ORDER = [
    "aiHedgePresent", "buzzPer100w", "templatePer100w", "discoursePer100w", "bigramRepeatRatio",
    "trigramRepeatRatio", "sentenceStarterRepeatRatio", "charTrigramRepeatRatio", "typeTokenRatio", "mattr25",
    "hapaxRatio", "sentenceLenCV", "avgSentenceLen", "wordLenCV", "paragraphLenCV", "contractionRatio",
    "firstPersonRatio", "secondPersonRatio", "shortSentenceRatio", "stopwordRatio", "listMarkerCount",
    "newlineRatio", "colonPer100w", "commaPer100w", "semicolonPer100w", "exclamationsPer100w", "questionsPer100w",
    "ellipsisPer100w", "quoteRatio", "parenRatio", "punctuationVariety", "emojiPresent", "topWordShare",
]
FEATURE_NAMES = {
    "aiHedgePresent": "AI self-disclosure",
    "buzzPer100w": "stock promotional wording",
    "templatePer100w": "generic template phrases",
    "discoursePer100w": "formal transition phrases",
    "bigramRepeatRatio": "word-pair repetition",
    "trigramRepeatRatio": "three-word repetition",
    "sentenceStarterRepeatRatio": "reused sentence openings",
    "typeTokenRatio": "raw lexical diversity",
    "mattr25": "length-adjusted lexical diversity",
    "sentenceLenCV": "sentence-length variation",
    "avgSentenceLen": "average sentence length",
    "wordLenCV": "word-length variation",
    "paragraphLenCV": "paragraph-length variation",
    "contractionRatio": "contractions",
    "firstPersonRatio": "first-person language",
    "secondPersonRatio": "second-person language",
    "shortSentenceRatio": "short-sentence share",
    "charTrigramRepeatRatio": "character-pattern repetition",
    "punctuationVariety": "punctuation variety",
    "listMarkerCount": "list structure",
    "colonPer100w": "colon density",
    "commaPer100w": "comma density",
    "exclamationsPer100w": "exclamation density",
    "questionsPer100w": "question density",
    "topWordShare": "most-common-word share",
}
#: platform -> kind -> words for weak, medium and high evidence
EVIDENCE_LIMITS = {
    "linkedin": {"post": (20, 35, 90), "comment": (15, 30, 65)},
    "reddit": {"post": (20, 35, 75), "comment": (15, 30, 60)},
    "x": {"post": (18, 30, 55), "comment": (15, 25, 45)},
    "unknown": {"post": (20, 35, 75), "comment": (15, 30, 60)},
}
