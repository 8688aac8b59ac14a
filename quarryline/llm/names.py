"""Variant spellings of names typed by people, linked by merge-and-rematch entity resolution.

Every author key is read into keys: addresses, logins and full names (strong), initial with surname, surname alone and
spellings with one letter left out (weak). Keys that share a strong key are one profile. Then profiles are rematched
with all the spellings their members brought together: a profile that is known only by an initial or a surname joins
the one full profile it can mean, and a full name that no address confirms joins the profile whose name differs by one
typing slip. Merged profiles enter blocking again until nothing merges any more. All of it is grouping and joining of
keys; within a block every profile is compared with one hub only, never all with all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import release, stored

#: Share of a domain's keys whose typed name holds the domain's first word, from which it is somebody's own; one with a single
#: address is too. A share, unlike a number of addresses, is alike at every size of the input.
OWN_DOMAIN = 0.2
_ACCENTS, _PLAIN = "äáàâãåéèêëíìîïöóòôõøúùûüçćčñńšśžżźłßğışřůěęąý", "aaaaaaeeeeiiiioooooouuuucccnnsszzzlsgisrueeay"

# Short forms of given names, by the full form.
_SHORT = {
    "alexander": "alex sasha xander alec", "alexandra": "alexa lexi", "aleksandra": "ola", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "brigid": "bridie biddy", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davey", "deirdre": "dee didi", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "ekaterina": "katya", "elizabeth": "liz beth betty lizzie eliza", "eleanor": "ellie nell", "francesca": "fran frankie cesca", "francisco": "paco pancho", "frederick": "fred freddy",
    "gabriela": "gabi gaby", "guillermo": "memo guille", "gregory": "greg", "henrik": "rik", "henry": "harry hank", "isabella": "bella", "jacob": "jake", "james": "jim jimmy jamie", "jelena": "lena", "jennifer": "jen jenny", "johannes": "hannes", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey",
    "joshua": "josh", "jurgen": "jurg", "katherine": "kate kathy katie kat", "lawrence": "larry", "leonard": "leo lenny", "margaret": "peg peggy meg maggie", "matthias": "matti hias matze", "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey micha", "nadia": "nadja", "nathaniel": "nate", "nicholas": "nick nicky nico", "patricia": "pat patty trish tricia",
    "patrick": "paddy", "philippa": "pip pippa", "philip": "phil", "quentin": "quin", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samantha": "sammie", "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy", "susan": "suzan", "tamsin": "tam tamsie", "theodore": "theo teddy",
    "thomas": "tom tommy", "timothy": "tim", "tomas": "tomasito", "victoria": "vicky tori", "wilhelmina": "mina", "william": "bill will billy willy liam", "zachary": "zach",
}
_GIVEN = {short: full for full, all_short in _SHORT.items() for short in all_short.split()}
_LEGAL = frozenset("gmbh llc ltd ag inc corp co sa sarl bv plc kg limited the team".split())
_ROLE = frozenset("dev oss info admin contact mail me hello office support opensource git".split())
_NOBODY = re.compile(r"\[bot\]|(?:^|[\W_\d])(?:bot|robot)s?$|^(?:ci|root|ghost|your name|admin|administrator|unknown|nobody|none|null|user|test|builder|build|jenkins|git|github|noreply|no reply|anonymous|deploy|developer)$", re.I)
_NO_ADDRESS = re.compile(r"localhost|^you@example|example\.com$|^(?:noreply|no-reply|root|ci|build|nobody|unknown|none)@|\[bot\]|^\s*$", re.I)
_RANDOM_LOGIN = re.compile(r"^[a-z]+[-_]?[a-z]+\d{2,}$", re.I)


def _fold(text: str) -> str:
    text = text.translate(str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "đ": "d", "’": "'"}))
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _mended(text: str) -> str:
    """A text whose UTF-8 bytes were read as Latin-1 or Windows-1252, put right."""
    for encoding in ("latin-1", "cp1252"):
        try:
            return text.encode(encoding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


def _given(token: str) -> str:
    return _GIVEN.get(token, token)


def _tokens(name: str) -> list[str]:
    """The words of a typed name: remarks in brackets, legal forms and titles left out, joined words split by case."""
    name = re.sub(r"[(\[][^)\]]*[)\]]", " ", _fold(_mended(name))).replace("'", "")
    name = " ".join(w for w in name.split() if w.lower().strip(".,") not in _LEGAL)
    name = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return re.findall(r"[a-z0-9]+", name.lower())


def _full(a: str, b: str) -> str:
    return "|".join(sorted((_given(a), _given(b))))


class Reading:
    """What one author key says: strong keys, full names with a flag whether an address confirms them, and partial names."""

    def __init__(self) -> None:
        self.strong: set[str] = set()
        self.names: dict[str, bool] = {}
        self.partial: set[str] = set()

    def name(self, a: str, b: str, confirmed: bool) -> None:
        if len(a) > 1 and len(b) > 1 and a != b:
            n = _full(a, b)
            self.names[n] = self.names.get(n, False) or confirmed
            self.strong.add(f"N:{n}")

    def initial(self, i: str, surname: str) -> None:
        if len(surname) > 2:
            self.partial.add(f"P:{i}|{surname}")

    def joined(self, word: str) -> None:
        """One word: maybe both names written together, or an initial and a surname."""
        if len(word) > 4:
            self.partial.add(f"C:{word}")
            self.initial(word[0], word[1:])

    def words(self, tokens: list[str], confirmed: bool, login: bool = False) -> None:
        """Tokens of a typed name, an address or a login."""
        long = [t for t in tokens if len(t) > 1 and not t.isdigit()]
        short = [t for t in tokens if len(t) == 1]
        if login and len(long) == 3:
            long = long[:2]  # the third is a company
        if len(long) == 2 and long[1] in ("dev", "code", "git", "hub") and login:
            self.partial.add(f"S:{long[0]}")
        elif len(long) == 2:
            self.name(long[0], long[1], confirmed)
        elif len(long) > 2:
            self.name(long[0], long[-1], confirmed)
        elif len(long) == 1 and short:
            self.initial(short[0], long[0])
        elif len(long) == 1:
            self.joined(long[0])


def read_key(name: str | None, email: str | None, login: str | None, own_domain: bool) -> Reading | None:
    """The reading of a commit's (name, email) or of a comment's login; None for bots, shared and placeholder accounts."""
    r = Reading()
    if login is not None:
        plain = login.strip()
        if _NOBODY.search(plain) or not plain:
            return None
        r.strong.add("L:" + re.sub(r"[-_.]", "", plain.lower()))
        if not _RANDOM_LOGIN.match(plain):
            r.words(_tokens(plain.replace("-", " ").replace("_", " ")), True, login=True)
        return r
    plain = (name or "").strip()
    if not plain or _NOBODY.search(plain):
        return None
    tokens = _tokens(plain)
    short = re.match(r"^(?:The )?([^\W\d_]{4,}) [^\W\d_]{2,4}\.(?: |$)", _fold(_mended(plain)))
    if short:  # a company whose second word is cut short
        r.partial.add(f"S:{short[1].lower()}")
        tokens = []
    if _RANDOM_LOGIN.match(plain):
        r.strong.add("L:" + re.sub(r"[-_.]", "", plain.lower()))
    elif re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+)*", plain):
        r.strong.add("L:" + re.sub(r"[-_]", "", plain))
        r.words(tokens, False, login=True)
    else:
        r.words(tokens, False)
    address = (email or "").strip().lower()
    if address and not _NO_ADDRESS.search(address) and "@" in address:
        local, _, domain = address.partition("@")
        hidden = re.match(r"^\d+\+(.+)$", local) if "noreply" in domain else None
        if hidden:
            r.strong.add("L:" + re.sub(r"[-_.]", "", hidden[1]))
            if not _RANDOM_LOGIN.match(hidden[1]):
                r.words(_tokens(hidden[1].replace("-", " ").replace("_", " ")), True, login=True)
        elif "noreply" not in domain:
            r.strong.add(f"E:{address}")
            parts = [p for p in re.split(r"[._\-+]", _fold(local)) if p and not p.isdigit()]
            host = [p for p in re.split(r"[.\-]", re.sub(r"-laptop(?=\.)", "", _fold(domain)))[:-1] if p]
            if _RANDOM_LOGIN.match(local):
                r.strong.add("L:" + re.sub(r"[-_.]", "", local))
            elif len(parts) >= 2:
                r.words(parts, True)
            elif parts and own_domain and host and (parts[0] in _ROLE or _given(parts[0]) in map(_given, tokens) or host[0] in "".join(tokens)):
                if parts[0] in _ROLE:
                    r.words(host, True) if len(host) > 1 else r.partial.add(f"S:{host[0]}")
                else:
                    r.name(parts[0], host[0], True)
            elif parts and parts[0].isalpha():
                r.joined(parts[0])
                if len(parts[0]) > 4:
                    given = next((t for t in tokens if len(t) > 1), "")
                    if given and parts[0][0] in (given[0], _given(given)[0]) and len([t for t in tokens if len(t) > 1]) == 1 and not parts[0].startswith(given):
                        r.name(given, parts[0][1:], True)
    return r


def one_slip(a: str, b: str) -> bool:
    """Whether two words differ by at most one letter more, less, other, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:]


def _slips(name: str) -> set[str]:
    """Blocking keys of a full name: each word with one letter left out or as it is, beside the other word."""
    a, b = name.split("|")
    out = set()
    for fixed, varied in ((a, b), (b, a)):
        if len(varied) > 3:
            out |= {f"F:{fixed}|{varied[:k]}{varied[k + 1 :]}" for k in range(len(varied))} | {f"F:{fixed}|{varied}"}
    return out


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = [sorted(_slips(n)) for n in batch.column("name").to_pylist()]
        rows = batch.select(["label", "name", "confirmed", "n"]).take(pa.array([k for k, b in enumerate(blocks) for _ in b], pa.int64()))
        yield rows.append_column("block", pa.array([x for b in blocks for x in b], pa.string()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, name, email, login, own in zip(*(batch.column(c).to_pylist() for c in ("key", "name", "email", "login", "own"))):
            r = read_key(name, email, login, bool(own))
            if r is not None:
                rows.append((key, sorted(r.strong), [{"name": n, "confirmed": c} for n, c in sorted(r.names.items())], sorted(r.partial)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.struct([("name", pa.string()), ("confirmed", pa.bool_())]))), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
            ["key", "strong", "names", "partial"],
        )


def _components(edges: DataFrame) -> DataFrame:
    """(node, key) -> (node, label): nodes that share keys, directly or over others, get the least node's name.

    Labels spread over keys as minima, which are added up before the shuffle, so a key of any size is one row per task.
    """
    edges = stored(edges.distinct())
    held = stored(edges.groupBy("node").agg(F.first("node").alias("label")))
    while True:
        labels = held.select("node", "label")
        by_key = edges.join(labels, "node").groupBy("key").agg(F.min("label").alias("least"))
        near = edges.join(by_key, "key").groupBy("node").agg(F.min("least").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        onward = spread.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        moved = stored(spread.join(onward, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("before")))
        release(held)
        held = moved
        if not moved.filter("label != before").head(1):
            release(edges)
            return moved.select("node", "label")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("name").to_pylist(), batch.column("hub_name").to_pylist()):
            (a, b), (c, d) = x.split("|"), y.split("|")
            keep.append(any(p == r and one_slip(q, s) for p, q, r, s in ((a, b, c, d), (b, a, d, c), (a, b, d, c), (b, a, c, d))))
        yield batch.filter(pa.array(keep, pa.bool_()))


def resolve(keys: DataFrame) -> DataFrame:
    """(key, name, email, login) -> (key, entity): keys of persons and organisations with their entity.

    Either login is set, or name and maybe email. Bots, shared and placeholder accounts have no row; repeated rows give
    one row; nulls in name and login together give none. An empty table gives none.
    """
    domain = F.lower(F.element_at(F.split(F.col("email"), "@"), -1))
    keys = keys.distinct().withColumn("domain", domain)
    host, typed = F.regexp_extract("domain", r"^([^.\-]+)", 1), F.regexp_replace(F.translate(F.lower("name"), _ACCENTS, _PLAIN), "[^a-z]", "")
    named = F.avg(F.when((host != "") & F.contains(typed, host), 1.0).otherwise(0.0))
    owned = keys.filter("email is not null").groupBy("domain").agg(((named >= OWN_DOMAIN) | (F.min(F.lower("email")) == F.max(F.lower("email")))).alias("own"))
    known = keys.join(owned, "domain", "left").select("key", "name", "email", "login", F.coalesce("own", F.lit(True)).alias("own"))
    readings = stored(known.mapInArrow(_read, "key string, strong array<string>, names array<struct<name:string,confirmed:boolean>>, partial array<string>"))
    strong = readings.select(F.col("key").alias("node"), F.explode("strong").alias("key"))
    lonely = readings.select(F.col("key").alias("node"), F.concat(F.lit("K:"), "key").alias("key"))
    entities = _components(strong.unionByName(lonely))
    while True:  # each merge leaves fewer entities
        members = readings.join(entities.withColumnRenamed("node", "key"), "key")
        names = members.select("label", F.explode("names").alias("n")).groupBy("label", "n.name").agg(F.bool_or("n.confirmed").alias("confirmed"), F.count("*").alias("n"))
        names = stored(names)
        # a profile's names mean these partial forms, whichever word is the surname
        words = names.select("label", F.split("name", r"\|").alias("w"))
        forms = words.select("label", F.explode(F.array(F.struct(F.col("w")[0].alias("given"), F.col("w")[1].alias("surname")), F.struct(F.col("w")[1].alias("given"), F.col("w")[0].alias("surname")))).alias("f"))
        meant = forms.select("label", F.explode(F.array(F.concat(F.lit("P:"), F.substring("f.given", 1, 1), F.lit("|"), "f.surname"), F.concat(F.lit("S:"), "f.surname"), F.concat(F.lit("C:"), "f.given", "f.surname"))).alias("form"))
        owners_of = stored(meant.groupBy("form").agg(F.min("label").alias("target"), F.max("label").alias("other")))
        owners = owners_of.filter("target = other").select("form", "target", F.col("target").alias("other"))
        partial = members.select("label", F.explode("partial").alias("form")).join(names.select("label").distinct(), "label", "left_anti").distinct()
        offers = partial.join(owners, "form").groupBy("label").agg(F.min("target").alias("target"), F.max("target").alias("other")).filter("target = other").select("label", "target")
        # partial profiles that no full one explains belong together if they have the same initial and surname
        orphans = partial.filter("form like 'P:%'").join(owners_of.select("form"), "form", "left_anti").select("form", "label")
        first = orphans.groupBy("form").agg(F.min("label").alias("target"))
        offers = offers.unionByName(orphans.join(first, "form").select("label", "target").filter("label != target"))
        # typing slips: in each block all names are compared with the best founded one
        blocks = stored(names.mapInArrow(_blocked, "label string, name string, confirmed boolean, n long, block string"))
        hubs = blocks.groupBy("block").agg(F.max(F.struct("confirmed", "n", "label", "name")).alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most")
        compared = blocks.join(hubs, "block").filter("label != hub.label and not (confirmed and hub.confirmed)").select("label", "name", F.col("hub.label").alias("target"), F.col("hub.name").alias("hub_name")).distinct()
        near = compared.mapInArrow(_verified, "label string, name string, target string, hub_name string")
        typed = near.groupBy("label").agg(F.min("target").alias("target"), F.max("target").alias("other")).filter("target = other").select("label", "target")
        merges = stored(offers.unionByName(typed).distinct())
        release(blocks, owners_of)
        if not merges.head(1):
            release(names, merges)
            break
        joined = _components(merges.select(F.col("label").alias("node"), "target").select(F.explode(F.array("node", "target")).alias("node"), F.concat_ws("\x1f", "node", "target").alias("key")))
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("united"))
        united = stored(entities.join(joined, "label", "left").select("node", F.coalesce("united", "label").alias("label")))
        release(names, merges, entities)
        entities = united
    return entities.select(F.col("node").alias("key"), F.col("label").alias("entity"))


def author_keys(commits: DataFrame, comments: DataFrame) -> DataFrame:
    """(key, name, email, login): the distinct author keys of commits with a name and of comments with an author."""
    typed = commits.filter(F.col("author_name").isNotNull()).select("author_name", "author_email").distinct()
    typed = typed.select(F.concat("author_name", F.lit(" <"), F.coalesce("author_email", F.lit("")), F.lit(">")).alias("key"), F.col("author_name").alias("name"), F.col("author_email").alias("email"), F.lit(None).cast("string").alias("login"))
    logins = comments.filter(F.col("author").isNotNull()).select("author").distinct()
    return typed.unionByName(logins.select(F.concat(F.lit("@"), "author").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("email"), F.col("author").alias("login")))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of different keys of one entity, the smaller first."""
    a, b = entities.select("entity", F.col("key").alias("key_a")), entities.select("entity", F.col("key").alias("key_b"))
    return a.join(b, "entity").filter("key_a < key_b").select("key_a", "key_b")
