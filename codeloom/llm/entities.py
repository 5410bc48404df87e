"""Problem 2: records of one person or organisation under variant spellings, by merge-and-rematch.

Records that share a mail (in one of its forms) or an account number are merged first.  A merged
profile holds the union of its records' spellings, initials and mails; it emits blocking keys again,
now with what its records know only together, and profiles that agree within one organisation are
merged, round after round, until a round merges nothing.  Merging follows connected components by
the least record id, joined in Spark; no component and no link is gathered in one place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERED_SHARE = 0.5  # a host most of whose mails carry an account number hands out mails to anybody
PUBLIC_HOSTS = ("gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "yahoo.com", "icloud.com", "me.com", "aol.com", "gmx.de", "gmx.net", "web.de", "proton.me", "protonmail.com", "mail.ru", "yandex.ru", "qq.com", "163.com")  # Free-mail hosts. Fixed values.
NICKNAMES = {  # Short forms of first names. Fixed values.
    "alex": "alexander", "ale": "alejandro", "ana": "anna", "andy": "andrew", "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "bill": "william", "bob": "robert", "chris": "christopher",
    "dan": "daniel", "dave": "david", "dick": "richard", "dima": "dmitri", "ed": "edward", "fran": "francisco", "gabi": "gabriela", "greg": "gregory", "hans": "johannes", "jim": "james", "joe": "joseph",
    "jon": "jonathan", "kate": "katherine", "katya": "ekaterina", "kathi": "katharina", "ken": "kenneth", "larry": "lawrence", "lena": "magdalena", "liz": "elizabeth", "maggie": "margaret", "matt": "matthew",
    "max": "maximilian", "mike": "michael", "nacho": "ignacio", "nick": "nicholas", "ola": "aleksandra", "paco": "francisco", "pat": "patrick", "pepe": "jose", "pete": "peter", "phil": "philip",
    "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samantha", "sasha": "aleksandr", "sepp": "josef", "steffi": "stefanie", "steve": "steven", "susi": "susanna",
    "tom": "thomas", "tony": "anthony", "uli": "ulrich", "vicky": "victoria", "vova": "vladimir", "wil": "william", "will": "william", "zosia": "zofia",
}
PARTICLES = frozenset("de la del den der di da do dos du le van von zu y e".split())
_NOREPLY = re.compile(r"^(\d+)\+([\w.\-]+)@users\.noreply\.")
_NUMBERED = re.compile(r"^(.*?[a-z])[._]?(\d{4,})$")
_ORG_WORDS = re.compile(r"\b(?:the|team|ltd|limited|inc|incorporated|gmbh|g m b h|ag|aktiengesellschaft|llc|corp|bot|co|sa|sarl)\b")
_ORG_MARK = re.compile(r"(?i)\b(?:software|systems|engineering|laborator(?:y|ies)|labs|technologies|team|gmbh|ltd|limited|inc|incorporated|ag|aktiengesellschaft|llc|corp|services|solutions)\b|g\.m\.b\.h|-bot$")


def fold(s: str) -> str:
    """ASCII in lower case; letters with marks and their two-letter spellings fall together."""
    s = s.translate(str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "đ": "d", "å": "a", "Å": "A", "ı": "i"}))
    s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower()
    return re.sub(r"([aou])e(?=[a-z])", r"\1", s)


def mail_keys(mail: str | None) -> list[str]:
    """Keys of a mail: itself without tag, brackets and case, or the account number; the three forms of an organisation's mail give one key."""
    if not mail:
        return []
    m = mail.strip().strip("<>()[]").strip().lower()
    m = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", "@", m)
    m = re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", ".", m)
    if not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", m):
        return []
    n = _NOREPLY.match(m)
    if n:
        return [f"#{n.group(1)}"]
    local, host = m.split("@", 1)
    local = local.split("+")[0]
    k = _NUMBERED.match(local)
    if k:
        return [f"#{k.group(2)}", f"{local}@{host}"]
    out = [f"{fold(local)}@{host}"]
    if local == "dev" and host.count(".") >= 2:
        name, org = host.split(".", 1)
        return [f"{name}@{org}"]
    if local.startswith("bot-"):
        return [f"{local[4:]}@{host}"]
    return out


def _last(tokens: list[str]) -> str:
    return "".join(t for t in tokens if t not in PARTICLES) or "".join(tokens)


def name_spellings(name: str | None) -> list[tuple[str, str]]:
    """(first, last) readings of a typed name; either may be an initial; both orders where the order is open."""
    if not name:
        return []
    s = re.sub(r"\(.*?\)", " ", name).strip()
    if _ORG_MARK.search(s):
        core = " ".join(_ORG_WORDS.sub(" ", re.sub(r"[^a-z0-9]+", " ", fold(s.replace("&", " and ")))).split())
        return [("org", core.replace(" ", ""))] if core else []
    s = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", s) if " " not in s else s
    if "," in s:
        last, _, first = s.partition(",")
        firsts, lasts = re.findall(r"[a-z]+", fold(first)), re.findall(r"[a-z]+", fold(last).replace("-", ""))
        return [(NICKNAMES.get(firsts[0], firsts[0]), _last(lasts))] if firsts and lasts else []
    tokens = re.findall(r"[a-z]+", fold(s).replace("-", "").replace("_", " "))
    if len(tokens) < 2:
        return []
    middle = [t for i, t in enumerate(tokens) if not (0 < i < len(tokens) - 1 and len(t) == 1)]
    out = [(NICKNAMES.get(middle[0], middle[0]), _last(middle[1:]))]
    if len(middle[-1]) > 1:
        out.append((NICKNAMES.get(middle[-1], middle[-1]), _last(middle[:-1])))
    return out


def mail_spellings(mail: str | None) -> list[tuple[str, str, str]]:
    """(host, first, last) readings of a mail's local part at an organisation."""
    out = []
    for k in mail_keys(mail):
        if k[0] == "#":
            continue
        local, host = k.split("@", 1)
        if re.search(r"\d", local):
            continue
        parts = [p for p in fold(local).replace("-", "").split(".") if p]
        stripped = lambda p: re.sub(r"^(?:dela|vonder|vander|van|von|del|de|di|da|la)(?=[a-z]{5})", "", p)
        if len(parts) == 2:
            for a, b in (parts, parts[::-1]):
                out.append((host, NICKNAMES.get(a, a), b))
                if stripped(b) != b:
                    out.append((host, NICKNAMES.get(a, a), stripped(b)))
        elif len(parts) == 1 and len(parts[0]) >= 5:
            out.append((host, parts[0][0], parts[0][1:]))
            if stripped(parts[0][1:]) != parts[0][1:]:
                out.append((host, parts[0][0], stripped(parts[0][1:])))
    return out


def near(a: str, b: str) -> bool:
    """Equal, or one letter more, less, other, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp: the least node that is reachable over links(key, node); rounds of least labels over keys and jumps until nothing changes."""
    from ..session import cut

    labels = nodes.select("node", F.col("node").alias("comp"))
    links = cut(links.select("key", "node").distinct())
    while True:
        least = links.join(labels, "node").groupBy("key").agg(F.min("comp").alias("least"))
        offered = links.join(least, "key").groupBy("node").agg(F.min("least").alias("least"))
        stepped = labels.join(offered, "node", "left").select("node", "comp", F.least("comp", F.coalesce("least", "comp")).alias("next"))
        roots = stepped.groupBy("comp").agg(F.min("next").alias("root"))  # a component that meets a smaller one moves as a whole
        new = cut(stepped.join(roots, "comp").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("comp")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


_EVIDENCE = "node string, mails array<string>, readings array<string>"


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mail keys of a record, and its readings: 'n|first|last' of names and 'm|host|first|last' of mails, hosts of the record's mails."""
    for pdf in batches:
        rows = []
        for node, name, email, aliases in zip(pdf["node"], pdf["name"], pdf["email"], pdf["aliases"], strict=True):
            mails, readings = set(), set()
            names = [name]
            for a in [email, *(aliases if aliases is not None else [])]:
                keys = mail_keys(a)
                if keys:
                    mails.update(keys)
                    readings.update("m|" + "|".join(x) for x in mail_spellings(a))
                    hosts = {k.split("@", 1)[1] for k in keys if k[0] != "#"}
                    hosts |= {h.split(".", 1)[1] for h in hosts if h.count(".") >= 2}
                    readings.update("h|" + h for h in hosts)
                elif a:
                    names.append(a)
            for n in names:
                readings.update("n|" + "|".join(x) for x in name_spellings(n))
            rows.append((node, sorted(mails), sorted(readings)))
        yield pd.DataFrame(rows, columns=["node", "mails", "readings"])


def _cuts(x: str) -> set[str]:
    """A word and what is left of it without one letter: two words that are near have one of these in common."""
    return {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}


_SPELLED = "comp string, host string, numbered boolean, spellings string"


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a profile is called in each of its organisations; names without an organisation's mail count in none."""
    for pdf in batches:
        rows = []
        for comp, mails, readings in zip(pdf["comp"], pdf["mails"], pdf["readings"], strict=True):
            numbered = any(m[0] == "#" for m in mails)
            names, own = set(), {}
            for r in readings:
                p = r.split("|")
                if p[0] == "n":
                    names.add((p[1], p[2]))
                elif p[0] == "m":
                    own.setdefault(p[1], set()).add((p[2], p[3]))
            for h in sorted(r[2:] for r in readings if r[0] == "h"):
                every = names | own.get(h, set())
                if every:
                    rows.append((comp, h, numbered, ";".join(f"{f},{x},{'n' if (f, x) in names else ''}{'m' if (f, x) in own.get(h, ()) else ''}" for f, x in sorted(every))))
        yield pd.DataFrame(rows, columns=["comp", "host", "numbered", "spellings"])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of a profile in an organisation: an initial with a whole last name, and with what is left of it without one letter."""
    for pdf in batches:
        rows = []
        for comp, h, numbered, text in zip(pdf["comp"], pdf["host"], pdf["numbered"], pdf["spellings"], strict=True):
            keys = set()
            for t in text.split(";"):
                f, x, _ = t.split(",")
                if len(x) >= 3:
                    keys.update(f"{h}|{f[0]}|{v}" for v in (_cuts(x) if len(f) > 1 and len(x) > 3 else (x,)))
            rows.extend((k, h, comp, numbered) for k in keys)
        yield pd.DataFrame(rows, columns=["key", "host", "comp", "numbered"])


def same(a: list[tuple[str, str, str]], b: list[tuple[str, str, str]]) -> bool:
    """Whether two profiles of one organisation spell one name.

    They do if a full spelling is in both; or if the last names agree and the first names are near or
    one is the other's initial; or if the first names agree and the last names are near.  Profiles
    whose name and mail each agree on another spelling are different people of like names.
    """
    af, bf = {(f, x) for f, x, _ in a if len(f) > 1}, {(f, x) for f, x, _ in b if len(f) > 1}
    if af & bf:
        return True
    both_a, both_b = {(f, x) for f, x, k in a if k == "nm" and len(f) > 1}, {(f, x) for f, x, k in b if k == "nm" and len(f) > 1}
    if both_a and both_b:
        return False
    firsts_a, firsts_b = {}, {}
    for f, x, _ in a:
        firsts_a.setdefault(x, set()).add(f)
    for f, x, _ in b:
        firsts_b.setdefault(x, set()).add(f)
    for x in firsts_a.keys() & firsts_b.keys():
        if len(x) < 3:
            continue
        fa, fb = firsts_a[x], firsts_b[x]
        la, lb = {f for f in fa if len(f) > 1}, {f for f in fb if len(f) > 1}
        if any(near(p, q) for p in la for q in lb):
            return True
        if (not la or not lb) and {f[0] for f in fa} & {f[0] for f in fb}:
            return True
    for f, x in af:
        for g, y in bf:
            if (f == g or near(f, g) and len(x) > 5) and len(x) > 4 and near(x, y):
                return True
    return False


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of profiles whose spellings in one organisation agree."""
    for pdf in batches:
        parsed = lambda text: [tuple(t.split(",")) for t in text.split(";")]
        kept = [same(parsed(x), parsed(y)) for x, y in zip(pdf["spellings_a"], pdf["spellings_b"], strict=True)]
        yield pdf.loc[kept, ["a", "b", "numbered_a", "numbered_b"]]


def _matches(profiles: DataFrame) -> DataFrame:
    """key, node: links between profiles that agree in an organisation.

    Candidates meet by an equality join on keys; no organisation is gathered.  Account numbers have
    been merged before, so that two profiles with numbers are two people: one without a number that
    agrees with several of them stays, and no chain of profiles without numbers joins two of them.
    """
    from ..session import cut

    spelled = cut(profiles.mapInPandas(_spelled, _SPELLED))
    keys = spelled.mapInPandas(_keyed, "key string, host string, comp string, numbered boolean")
    a = keys.select("key", "host", F.col("comp").alias("a"), F.col("numbered").alias("numbered_a"))
    b = keys.select("key", F.col("comp").alias("b"), F.col("numbered").alias("numbered_b"))
    met = a.join(b, "key").where("a < b AND NOT (numbered_a AND numbered_b)").select("host", "a", "b", "numbered_a", "numbered_b").distinct()
    texts = spelled.select("host", "comp", "spellings")
    met = met.join(texts.withColumnsRenamed({"comp": "a", "spellings": "spellings_a"}), ["host", "a"]).join(texts.withColumnsRenamed({"comp": "b", "spellings": "spellings_b"}), ["host", "b"])
    hits = cut(met.select("a", "b", "numbered_a", "numbered_b", "spellings_a", "spellings_b").mapInPandas(_agreeing, "a string, b string, numbered_a boolean, numbered_b boolean").distinct())
    ends = hits.select(F.col("a").alias("node"), F.col("numbered_b").alias("other")).unionByName(hits.select(F.col("b").alias("node"), F.col("numbered_a").alias("other")))
    torn = ends.where("other").groupBy("node").count().where("count > 1").select("node")
    hits = cut(hits.join(torn.withColumnRenamed("node", "a"), "a", "left_anti").join(torn.withColumnRenamed("node", "b"), "b", "left_anti"))
    if hits.isEmpty():
        return _links(hits)
    sides = hits.select(F.col("a").alias("node"), F.col("numbered_a").alias("numbered")).unionByName(hits.select(F.col("b").alias("node"), F.col("numbered_b").alias("numbered"))).distinct()
    comps = _components(sides.select("node"), _links(hits)).join(sides, "node")
    mixed = comps.groupBy("comp").agg(F.count_if("numbered").alias("n")).where("n > 1")
    chained = comps.join(mixed, "comp", "left_semi").select(F.col("node").alias("a"))
    sure = hits.where("numbered_a OR numbered_b").unionByName(hits.where("NOT numbered_a AND NOT numbered_b").join(chained, "a", "left_anti"), allowMissingColumns=False)
    return cut(_links(sure))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws("~", "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))


def _of_organisations(records: DataFrame) -> DataFrame:
    """The records without the readings at free-mail hosts, which are told by their mails, however many records they have."""
    mails = records.select(F.explode("mails").alias("mail")).where("mail NOT LIKE '#%'").distinct()
    hosts = mails.groupBy(F.substring_index("mail", "@", -1).alias("host")).agg(F.avg(F.col("mail").rlike(r"[a-z][._]?\d{4,}@").cast("int")).alias("numbered"))
    free = hosts.where((F.col("numbered") > NUMBERED_SHARE) | F.col("host").isin(*PUBLIC_HOSTS)).select("host")
    readings = records.select("node", F.explode("readings").alias("r")).withColumn("host", F.when(~F.col("r").startswith("n|"), F.split_part("r", F.lit("|"), F.lit(2))))
    kept = readings.join(free, "host", "left_anti").groupBy("node").agg(F.collect_set("r").alias("readings"))
    return records.select("node", "mails").join(kept, "node", "left").select("node", "mails", F.coalesce("readings", F.array().cast("array<string>")).alias("readings"))


def resolve(developers: DataFrame) -> DataFrame:
    """id, entity: the least id of the records of the same person or organisation, for every id.

    Repeated deliveries of an id add their spellings.  Null or empty names and mails give no
    evidence; such records stay alone, as do records of an empty table.  At hosts that hand out mails
    to anybody, mails link only when equal; every organisation is matched, however large.
    """
    from ..session import cut

    src = developers.where(F.col("id").isNotNull()).select(F.col("id").alias("node"), "name", "email", "aliases")
    records = cut(src.mapInPandas(_evidence, _EVIDENCE).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("mails"))).alias("mails"), F.array_distinct(F.flatten(F.collect_set("readings"))).alias("readings")))
    links = records.select("node", F.explode("mails").alias("key"))
    labels = _components(records.select("node"), links)
    records = cut(_of_organisations(records))
    while True:  # each round with a match leaves fewer profiles
        profiles = (
            labels.join(records, "node")
            .select("comp", "mails", "readings")
            .groupBy("comp")
            .agg(F.array_distinct(F.flatten(F.collect_set("mails"))).alias("mails"), F.array_distinct(F.flatten(F.collect_set("readings"))).alias("readings"))
        )
        found = _matches(profiles)
        if found.isEmpty():
            break
        merged = _components(found.select("node").distinct(), found)
        labels = cut(labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
    return labels.select(F.col("node").alias("id"), F.col("comp").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """id_a < id_b of every two ids of one entity."""
    a, b = entities.select(F.col("id").alias("id_a"), "entity"), entities.select(F.col("id").alias("id_b"), "entity")
    return a.join(b, "entity").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
