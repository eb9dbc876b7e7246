"""Fixed values that must equal the original system's for the same results.

They are kept here as plain text, in their natural order. Operators take them as
small dimension tables (see ``sources/tables.py``), so users can pass their own.
"""

# --- fixed values: stop words of the per-post top-5 keyword extractor (C10) ---
# (the literal list holds duplicates; the set has 126 words)
KEYWORD_STOPWORDS_TEXT = """
the a an is are was were be been
being have has had do does did will
would could should may might must shall
to of in for on with at by from
as into through during before after above
below between under again further then once
and but or nor so yet both either
neither not only own same than too very
just also now here there when where why
how all each every both few more most
other some such no nor not only own
i me my myself we our ours ourselves
you your yours yourself yourselves he him
his himself she her hers herself it its
itself they them their theirs themselves
what which who whom this that these those
am is are was were be been being
like just really much even still well
"""

# --- fixed values: English stop words of the lemmatising keyword variant (C11) ---
ENGLISH_STOPWORDS_TEXT = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
"""

# --- fixed values: site words added to the English stop words (C11, C12) ---
SITE_STOPWORDS_TEXT = "http https www com reddit post comment edit deleted removed amp"

# --- fixed values: irregular nouns of English, plural and singular ---
IRREGULAR_NOUNS_TEXT = """
men man
women woman
children child
feet foot
teeth tooth
geese goose
mice mouse
lice louse
oxen ox
knives knife
wives wife
lives life
leaves leaf
loaves loaf
halves half
dice die
pence penny
brethren brother
criteria criterion
phenomena phenomenon
bacteria bacterium
media medium
data datum
strata stratum
errata erratum
curricula curriculum
memoranda memorandum
indices index
appendices appendix
matrices matrix
vertices vertex
vortices vortex
analyses analysis
bases basis
crises crisis
theses thesis
hypotheses hypothesis
diagnoses diagnosis
oases oasis
parentheses parenthesis
cacti cactus
fungi fungus
nuclei nucleus
radii radius
stimuli stimulus
alumni alumnus
foci focus
larvae larva
antennae antenna
formulae formula
nebulae nebula
"""

# --- fixed values: labels, thresholds and weights ---
LABELS5 = ["very_negative", "negative", "neutral", "positive", "very_positive"]
CLASS_WEIGHTS = [-1.0, -0.5, 0.0, 0.5, 1.0]
DISPLAY_LABELS5 = ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative"]
DEFAULT_AUTHOR = "[deleted]"
ALERT_THRESHOLD = -0.5
ZSCORE_THRESHOLD = 2.0
CRITICAL_ZSCORE = 3.0

# --- default topics used when the registry has no active topic (B8) ---
DEFAULT_TOPICS = [
    ("technology", ["technology", "programming", "artificial"]),
    ("finance", ["finance", "stocks", "investing"]),
]

# --- lexicon-scoring modifier words and constants (published method; parameters) ---
NEGATORS_TEXT = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't
daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't
hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor
not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't
shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom
despite
"""
BOOSTERS_UP_TEXT = """
absolutely amazingly awfully completely considerably decidedly deeply effing
enormously entirely especially exceptionally extremely fabulously flipping
flippin fricking frickin frigging friggin fully fucking greatly hella highly
hugely incredibly intensely majorly more most particularly purely quite really
remarkably so substantially thoroughly totally tremendously uber unbelievably
unusually utterly very
"""
BOOSTERS_DOWN_TEXT = """
almost barely hardly kinda kindof kind-of less little marginally occasionally
partly scarcely slightly somewhat sorta sortof sort-of
"""
# phrases of the method: those that boost what follows, and idioms with a valence of their own
PHRASE_BOOSTERS_DOWN_TEXT = """
kind of
sort of
just enough
"""
IDIOMS_TEXT = """
the shit 3
the bomb 3
bad ass 1.5
bus stop 0
yeah right -2
cut the mustard 2
kiss of death -1.5
hand to mouth -2
to die for 3
beating heart 3.1
broken heart -2.9
"""
NEVER_INTENSIFIERS = ("so", "this")
NEVER_SCALAR = 1.25
BOOST_INCREMENT = 0.293
BOOST_DECREMENT = -0.293
QUESTION_INCREMENT, QUESTION_LIMIT = 0.18, 0.96
CAPS_INCREMENT = 0.733
NEGATION_SCALAR = -0.74
EXCLAMATION_INCREMENT = 0.292
EXCLAMATION_MAX = 4
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
NORMALISE_ALPHA = 15.0

# A small seed lexicon (word, valence on the -4..+4 scale) so the scorer runs
# without downloads. Load a full lexicon file with ``load_lexicon`` for real use.
SEED_LEXICON_TEXT = """
good 1.9
great 3.1
excellent 2.7
amazing 2.8
love 3.2
like 2.0
happy 2.7
nice 1.8
best 3.2
better 1.9
wonderful 2.7
awesome 3.1
fantastic 2.6
win 2.8
success 2.7
gain 2.4
growth 1.6
strong 2.3
positive 2.6
fun 2.3
bad -2.5
terrible -2.1
awful -2.0
hate -2.7
worst -3.1
worse -2.1
poor -2.1
sad -2.1
angry -2.3
fail -2.5
failure -2.3
loss -1.3
crash -1.7
weak -1.9
negative -2.7
problem -1.7
error -1.7
broken -2.1
wrong -2.1
risk -1.1
"""


def words(text: str) -> list[str]:
    """Split a fixed-value block into words, keeping first-seen order, no duplicates."""
    seen, out = set(), []
    for w in text.split():
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


def phrase_lines(text: str) -> list[str]:
    return [ln.strip() for ln in text.strip().splitlines() if ln.strip()]


def phrases() -> list[tuple[str, str, float]]:
    """(phrase, "boost" or "idiom", value) of the method's phrases."""
    out = [(p, "boost", BOOST_DECREMENT) for p in phrase_lines(PHRASE_BOOSTERS_DOWN_TEXT)]
    for ln in phrase_lines(IDIOMS_TEXT):
        p, v = ln.rsplit(" ", 1)
        out.append((p, "idiom", float(v)))
    return out


def seed_lexicon() -> list[tuple[str, float]]:
    out = []
    for ln in phrase_lines(SEED_LEXICON_TEXT):
        w, v = ln.split()
        out.append((w, float(v)))
    return out
