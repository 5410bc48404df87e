"""Problem 8: features of a text for abusive, hateful or sexual content, and the boosted trees that score them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lexicons, without accents, of four languages (en, de, fr, es). Fixed values.
INSULTS = (
    "idiot idiots moron morons imbecile cretin halfwit dumbass asshole assholes arsehole prick bitch bitches bastard scumbag loser losers clown parasite parasites jerk twat wanker dickhead shithead "
    "fool dimwit retard retarded pig cunt whore slut scum filth vermin cockroach cockroaches subhuman rat rats leech nitwit simpleton monkey brain-dead braindead lazy-ass "
    "arschloch vollidiot trottel depp dummkopf versager abschaum kruppel hurensohn wichser schlampe missgeburt spast penner vollpfosten drecksau "
    "connard connards connasse abruti abrutie debile ordure salope batard encule enculee couillon cretine cretin raclure "
    "idiota idiotas imbecil imbeciles cabron gilipollas pendejo zorra puta puto subnormal payaso estupido estupida"
).split()
DEGRADING = (
    "stupid dumb pathetic worthless useless miserable disgusting ugly stinking stink stinks lazy inferior dirty trash garbage disease animals animal plague subhuman parasites vermin cockroaches cancer crawling infest "
    "dumm blod dumme mull dreck entsorgt nutzlos widerlich minderwertig betes bete nul pourri inutile sales basura asco inutil inutiles sucios plaga sobran"
).split()
SEXUAL = (
    "dick dicks cock cocks tits boobs pussy ass arse thighs naked nude nudes nudity fuck fucking-you horny moaning moan blowjob porn cum orgasm penis vagina lips undress strip panties bra kinky "
    "hintern arsch titten nackt nackte ficken geil muschi schwanz ausziehen brueste bruste "
    "nue nus seins baiser bite cul chatte sucer desnuda desnudo culo tetas follar polla cono mamada"
).split()
THREATS = [
    r"kill (?:yourself|urself|you|him|her|them)\b", r"\b(?:cut|slit) (?:your|his|her|their|those) throats?", r"break (?:your|his|her|their|those|every) \w+", r"beat (?:you|him|her|them|up)\b", r"push (?:you|him|her|them) under",
    r"burn (?:your|his|her|their|those|down) ", r"\b(?:i|we)(?: will|'ll| shall)? (?:find|hunt|get|destroy|hurt|end) you\b", r"know where (?:you|he|she|they|@|my friend|reviewer)\b.*(?:live|park|work|sleep)", r"where you live",
    r"should be (?:shot|hanged|hung|beaten|killed|put down)", r"(?:hope|wish) (?:you|he|she|they) (?:die|get run|get hit|choke|rot|burn|never wake)", r"get run over", r"\b(?:just )?(?:disappear and die|drop dead|go die)\b", r"take a rope", r"go to hell",
    r"better without you", r"\bshut up\b", r"\byou stink", r"pieces? of shit", r"such an? (?:\w+ )?(?:creature|waste)", r"screw you|fuck (?:you|off|u)\b", r"piss off",
    r"\bwo du wohnst", r"verprugel", r"umbring", r"baseballschlager", r"\bhalt die (?:fresse|klappe|schnauze)", r"verpiss dich", r"gehort (?:entsorgt|erschossen|verprugelt)", r"geh sterben|verrecke",
    r"ou tu habites", r"qu'?(?:il|elle) creve", r"\bcreve\b", r"ferme ta gueule|ta gueule", r"va te faire", r"te casser la|je vais te|fais attention a toi", r"nique ta",
    r"donde vives", r"te mueras|muerete", r"callate", r"vete a la mierda", r"te vas a arrepentir", r"te voy a (?:matar|romper|buscar)", r"hijo de p", r"pedazo de",
]
ADVANCES = [
    r"suck (?:my|on|me)", r"(?:send|show) me (?:your |some |a )?(?:nudes?|tits|ass|dick|cock|lips|thighs|body|boobs|photos? of you)", r"get hard", r"slept with|sleeps? with|sleeping with", r"on (?:her|his|your) knees", r"want to (?:fuck|bed|undress|lick)", r"in my mouth|in my bed",
    r"(?:naked|nude) (?:on|in|with|for)", r"your (?:ass|tits|lips|thighs|body|legs|cock|dick)\b", r"dreamt? (?:of|about) (?:your|you)",
    r"zieh dich aus", r"ins bett", r"mit diesem (?:hintern|arsch|korper)", r"photos? de toi nue?", r"te baiser", r"envie de te", r"fotos? (?:tuyas )?desnud[ao]", r"con ese culo", r"ven a mi (?:casa|cama)",
]
GROUPS = (
    r"\b(?:women|woman|girls?|females?|jews?|muslims?|christians?|immigrants?|migrants?|refugees?|foreigners?|gays?|gay people|lesbians?|trans people|black (?:people|developers|men|women)|blacks|asians?|arabs?|gypsies|"
    r"disabled people|cripples?|old people|elderly|your kind|people like (?:you|him|her|them)|frauen|madchen|auslander|fluchtlinge|juden|muslime|schwule|behinderte|femmes|filles|etrangers?|juifs|musulmans|immigres|refugies|"
    r"mujeres|chicas|extranjeros|judios|musulmanes|inmigrantes|refugiados)\b"
)
HATE = [
    r"back to the kitchen|no place for a (?:girl|woman)", r"go back to where", r"did not exist|should not exist|ought to be (?:gone|removed|shot)", r"too (?:dumb|stupid|lazy) to",
    r"\b(?:are|is) (?:a |all )?(?:disease|animals|vermin|parasites|trash|subhuman|cockroaches|scum|plague|inferior|filth|cancer)", r"throw them (?:all )?out", r"(?:never|not) be allowed (?:near|to|in)", r"brains? (?:are|is) not made", r"not (?:be )?allowed to (?:code|work|vote)", r"nichts verloren", r"nicht arbeiten durfen", r"sind alle", r"konnen nicht (?:programmieren|denken)",
    r"trop (?:bete|nul|stupide)s?", r"rien a faire (?:dans|ici)", r"rentrent chez (?:eux|elles)", r"no sirven", r"son (?:basura|una plaga|animales)", r"sobran", r"vuelvan a su",
]
PERSON = frozenset(
    "you your yours yourself u ur urself ya he she him her his them they who whoever reviewer friend @ du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous ti tus contigo usted ella el espece eres es bist".split()
)
# Words that show that a hit speaks of code, tools or of the word itself. Fixed values.
TECHNICAL = frozenset(
    "process processes child parent zombie node host server domain terminal build test tests hack code flag job jobs letters queue list filter filters term terms rules rule forbid word words wort mot palabra liste sperrliste lista filtro filtre "
    "column field form status guide proof script crawler parser compiler branch check scores upload report folder penetration kindprozess elternprozess prozess processus proceso prueba release analytics import".split()
)
_LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "|": "l", "+": "t", "8": "b", "€": "e"})
_CYR = str.maketrans("аеорсухіїкмнтвѕԁ", "aeopcyxiikmhtbsd")
_WORDS = re.compile(r"@[\w.]+|[^\W_]+(?:['’\-][^\W_]+)*|[^\s\w]+")
_PASSAGE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<![\w])(?:[A-Za-z@$!013457*]([ ._\-]))(?:[A-Za-z@$!013457*]\1){2,}[A-Za-z@$!013457*](?![\w])")
_MASKED = re.compile(r"(?<![\w*])([A-Za-z])([*#]{2,})([A-Za-z]?)(?![\w*])")
_STAR = re.compile(r"(?<!\w)[@$][\w@$!]{3,}|[A-Za-z][A-Za-z*@$!#\d]*[*@$!#\d][A-Za-z*@$!#\d]*")
_RE_T, _RE_A, _RE_H = (re.compile("|".join(x)) for x in (THREATS, ADVANCES, HATE))
_RE_G = re.compile(GROUPS)
_QUOTED = re.compile(r"[\"“”„«»‘’'`]([^\"“”„«»‘’'`]{2,40})[\"“”„«»‘’'`]")
_HITS = frozenset(INSULTS) | frozenset(SEXUAL)
_STRONG = frozenset(w for w in _HITS if len(w) >= 4)
_BY_ENDS: dict[tuple[str, str, int], str] = {}
for _w in [*INSULTS, *SEXUAL, *DEGRADING, "kill yourself", "fucking", "fresse", "gueule", "shut up", "go to hell", "bloody", "goddamn", "piece of shit"]:
    _BY_ENDS.setdefault((_w[0], _w[-1], len(_w)), _w)
_SORTED = {"".join(sorted(w)): w for w in [*(x for x in _STRONG if x in INSULTS and "-" not in x and len(x) >= 5), "dick", "cock", "tits", "fuck", "fucking"]}
_PROFANE = frozenset("fuck fucking fucked shit bullshit damn goddamn bloody crap hell scheisse mist verdammt merde putain bordel joder mierda cono".split())
_SCREEN = re.compile(r"[*@$#]|(?<![A-Za-z])[A-Za-z]([ ._\-])[A-Za-z]\1[A-Za-z](?![A-Za-z])|[0-9][a-z]|[a-z][0-9]", re.I)
_RUNG = re.compile(r"(?<![A-Za-z])[A-Za-z](?:_ ?_?[A-Za-z]){3,}(?![A-Za-z])")

# Of the passage with most hits: kinds of hits by its words, the nearness of a person to them, and what speaks against them;
# of the whole text: hits, capitals, exclamation marks and disguised words by its words.
IN_PASSAGE = ("insult", "quoted", "degrade", "sexual", "threat", "advance", "group", "hate", "profane", "technical", "person", "obfuscated", "capitals", "exclaim")
NEAR = ("insult_near", "degrade_near", "sexual_near", "profane_near", "group_near")
IN_TEXT = ("insult", "degrade", "sexual", "threat", "advance", "hate", "profane", "technical", "obfuscated", "capitals", "exclaim")
FEATURES = (*IN_PASSAGE, *NEAR, *[f"text_{k}" for k in IN_TEXT], "kinds", "second", "words", "share")


def _plain(s: str) -> str:
    if "Ã" in s or "Â" in s:  # UTF-8 that was read as Latin text
        try:
            s = s.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    s = unicodedata.normalize("NFKD", s.translate(_CYR))
    s = "".join(ch for ch in s if not unicodedata.combining(ch) and ch not in "​‌‍­﻿")
    return re.sub(r"[ \t]+", " ", s.replace("ß", "ss").replace("’", "'"))


def reveal(s: str) -> tuple[str, int]:
    """The text in lower case with disguised words written out, and how many of them were found."""
    n = 0

    def spaced(m: re.Match) -> str:
        nonlocal n
        w = re.sub(r"[ ._\-]", "", m.group()).translate(_LEET).lower()
        if w in _HITS or w in _PROFANE:
            n += 1
            return w
        return m.group()

    def masked(m: re.Match) -> str:
        nonlocal n
        size = len(m.group())
        w = next((v for (a, z, k), v in _BY_ENDS.items() if k == size and a == m.group(1).lower() and (z == m.group(3).lower() or not m.group(3))), None)
        if w:
            n += 1
            return w
        return m.group()

    def starred(m: re.Match) -> str:
        nonlocal n
        raw = m.group().lower()
        if raw.isalpha() or raw.startswith("@") and raw[1:].isalnum() and not raw[1:].translate(_LEET).isalpha():
            return raw
        w = re.sub(r"(.)\1{2,}", r"\1", raw.translate(_LEET))
        if w in _HITS or w in _PROFANE or w in DEGRADING or w in ("yourself", "kill"):
            n += 1
            return w
        if "*" in w and len(w) >= 4:
            pattern = re.compile(w.replace("*", "."))
            hit = next((v for v in (*INSULTS, *SEXUAL, *_PROFANE, "yourself") if len(v) == len(w) and pattern.fullmatch(v)), None)
            if hit:
                n += 1
                return hit
        return raw

    def rung(m: re.Match) -> str:
        nonlocal n
        w = m.group().replace("_", "").translate(_LEET).lower()
        n += w in _HITS or w in _PROFANE or " " in w
        return w

    out = _plain(s)
    out = _RUNG.sub(rung, out)
    out = _SPACED.sub(spaced, out)
    out = _MASKED.sub(masked, out)
    out = _STAR.sub(starred, out).lower()
    words = []
    for w in out.split(" "):
        core = w.strip(".,;:!?\"'()[]")
        if len(core) >= 4 and core.isalpha() and core not in _HITS:
            c = re.sub(r"(.)\1{2,}", r"\1", core)
            c2 = re.sub(r"(.)\1{2,}", r"\1\1", core)
            fixed = next((x for x in (c, c2) if x != core and (x in _HITS or x in _PROFANE or x in DEGRADING or x in ("fuck", "dead", "brain-dead"))), None)
            if fixed is None and 4 <= len(core) <= 9:
                v = _SORTED.get("".join(sorted(core)))
                if v and sum(a != b for a, b in zip(v, core, strict=True)) == 2 and any(core[:i] + core[i + 1] + core[i] + core[i + 2 :] == v for i in range(len(core) - 1)):
                    fixed = v
            if fixed:
                n += 1
                w = w.replace(core, fixed)
        elif "-" in core and re.search(r"(.)\1{2,}", core):
            c = re.sub(r"(.)\1{2,}", r"\1", core)
            if c in _HITS:
                n += 1
                w = w.replace(core, c)
        words.append(w)
    return " ".join(words), n


_INS, _SEX, _DEG = frozenset(INSULTS), frozenset(SEXUAL), frozenset(DEGRADING)


def passage(s: str) -> dict[str, float] | None:
    """Evidence in one passage; None if no lexicon entry is in it."""
    low, hidden = reveal(s) if _SCREEN.search(s) or re.search(r"(.)\1\1", s) else (_plain(s).lower(), 0)
    if not hidden:
        low2, hidden = reveal(s) if any("".join(sorted(w)) in _SORTED for w in re.findall(r"[a-z]{4,9}", low)) else (low, 0)
        low = low2
    toks = [t.lower() for t in _WORDS.findall(low)]
    quoted = " ".join(_QUOTED.findall(low))
    quoted_words = set(re.findall(r"[\w\-]+", quoted))
    ins, sex, deg, prof, per, tech = [], [], [], [], [], 0
    q = 0
    for i, t in enumerate(toks):
        bare = t.strip("-'")
        if bare in _INS:
            if bare in quoted_words:
                q += 1
            else:
                ins.append(i)
        elif bare in _SEX and bare not in quoted_words:
            sex.append(i)
        if bare in _DEG and bare not in quoted_words:
            deg.append(i)
        if bare in _PROFANE:
            prof.append(i)
        if bare in PERSON or t.startswith("@") and len(t) > 1 or bare in ("du'", "t'es", "you're", "u're"):
            per.append(i)
        if bare in TECHNICAL or "-proof" in bare:
            tech += 1
    threat = len(_RE_T.findall(low)) if not quoted or not _RE_T.search(quoted) else 0
    advance = len(_RE_A.findall(low))
    group = len(_RE_G.findall(low))
    hate = len(_RE_H.findall(low))
    if not (ins or sex or deg or prof or q or threat or advance or group or hate or hidden):
        return None

    def near(hits: list[int]) -> float:
        return max((1 / (1 + min(abs(h - p) for p in per) / 4) for h in hits), default=0.0) if per and hits else 0.0

    words = max(1, len(toks))
    counts = {
        "insult": len(ins), "quoted": q, "degrade": len(deg), "sexual": len(sex), "threat": threat, "advance": advance, "group": group, "hate": hate, "profane": len(prof), "technical": tech, "person": len(per), "obfuscated": hidden,
        "capitals": sum(1 for w in re.findall(r"\b[A-Z]{4,}\b", s) if w.lower() in _HITS or w.lower() in _DEG), "exclaim": s.count("!"),
    }
    near_by = {"insult_near": near(ins), "degrade_near": near(deg), "sexual_near": near(sex), "profane_near": near(prof), "group_near": float(bool(group and (hate or deg or ins)))}
    # how many kinds of hits there are, less what speaks of code or quotes: picks the passage, no more
    kinds = sum(bool(counts[k]) for k in ("insult", "sexual", "threat", "advance", "hate", "obfuscated")) + sum(near_by[k] > 0 for k in ("insult_near", "degrade_near", "sexual_near")) + near_by["group_near"] - bool(tech) - bool(q)
    return {"counts": counts, "near": near_by, "kinds": float(kinds), "words": words}


def features(text: str | None, cache: dict[str, dict | None] | None = None) -> list[float]:
    """The dense features of a text: densities in its passage with most kinds of hits, and in the whole."""
    best: dict | None = None
    second, words, total = 0.0, 0, dict.fromkeys(IN_TEXT, 0)
    for s in _PASSAGE.split(text or ""):
        s = s.strip()
        if len(s) < 3:
            continue
        words += s.count(" ") + 1
        if cache is not None and s in cache:
            f = cache[s]
        else:
            f = passage(s)
            if cache is not None:
                if len(cache) > 20000:
                    cache.clear()
                cache[s] = f
        if f is None:
            continue
        for k in IN_TEXT:
            total[k] += f["counts"][k]
        if best is None or (f["kinds"], sum(f["near"].values())) > (best["kinds"], sum(best["near"].values())):
            second, best = (best["kinds"] if best else 0.0), f
        else:
            second = max(second, f["kinds"])
    if best is None:
        return [0.0] * (len(FEATURES) - 2) + [min(4.0, words / 200), 0.0]
    n = best["words"]
    return [
        *(best["counts"][k] / n for k in IN_PASSAGE), *(best["near"][k] for k in NEAR), *(total[k] / max(1, words) for k in IN_TEXT),
        best["kinds"], second, min(4.0, words / 200), n / max(n, words),
    ]


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id, source and the features of each document, whole texts; null and empty texts have none but zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            rows = [features(t, cache) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=list(FEATURES), dtype="float64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "source", pdf["source"].to_numpy())
            yield out

    schema = "doc_id bigint, source string, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").mapInPandas(run, schema)


# --- model ----------------------------------------------------------------------------------------

LABEL_BOUND = 40_000  # ratings that the trees are fitted on, at most
TREES, DEPTH, STEP = 25, 3, 0.25
THRESHOLD = 0.5


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score of each document: the calibrated chance that a passage of it is abusive, hateful or sexual.

    docs: doc_id, source, text; labels: doc_id, rater, abusive, one row for each rating, so that raters
    who disagree pull both ways.  The features of all documents are computed once; the trees are
    fitted on at most LABEL_BOUND ratings, and calibrated by isotonic regression on a quarter of them
    that they haven't seen.  Documents without text score as such.  Where the ratings are not of two
    kinds, as without any, all scores are 0.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from ..session import cut

    spark = docs.sparkSession
    feats = cut(featurize(docs))
    h = F.xxhash64("doc_id")
    rated = labels.where(F.col("abusive").isin(0, 1)).select("doc_id", F.col("abusive").cast("double").alias("label")).orderBy(h).limit(LABEL_BOUND)
    train = feats.join(F.broadcast(rated), "doc_id").withColumn("weight", F.lit(1.0)).withColumn("held", F.pmod(h, F.lit(4)) == 0)
    rows = train.select(*FEATURES, "label", "weight", "held").toPandas()  # at most LABEL_BOUND narrow rows
    fit, held = rows[~rows["held"]], rows[rows["held"]]
    if fit["label"].nunique() < 2:
        return feats.select("doc_id", "source", F.lit(0.0).alias("score"))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    local = assemble.transform(spark.createDataFrame(fit[[*FEATURES, "label", "weight"]])).coalesce(2)
    least = max(1, min(20, int(0.004 * len(fit))))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, weightCol="weight", minInstancesPerNode=least, seed=1, subsamplingRate=0.9).fit(local)
    margin = vector_to_array("rawPrediction")[1]

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(assemble.transform(df)).withColumn("margin", margin)

    if held["label"].nunique() == 2 and len(held) >= 40:
        cal = raw(spark.createDataFrame(held[[*FEATURES, "label", "weight"]])).select("margin", "label", "weight").coalesce(1)
    else:  # too few held-out ratings: all of them
        cal = raw(spark.createDataFrame(rows[[*FEATURES, "label", "weight"]])).select("margin", "label", "weight").coalesce(1)
    iso = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(cal)
    return iso.transform(raw(feats).select("doc_id", "source", "margin")).select("doc_id", "source", F.col("prediction").alias("score"))


def rates(scores: DataFrame) -> DataFrame:
    """source, documents, abusive documents and their rate; documents without a source fall together under (none)."""
    return (
        scores.groupBy(F.coalesce("source", F.lit("(none)")).alias("source"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("abusive"), F.round(F.avg("score"), 6).alias("mean_score"))
        .withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
    )
