"""URL filter: host and path rules first, else a weighted vocabulary of terms.

Rules are ``(rule, verdict)`` with rule = host + path; one fits its host and all
subdomains when the url's path starts with the rule's path, and the longest wins
(of equally long ones the first given).  A url that no rule fits is judged by its terms:
one Aho-Corasick pass finds strict and soft terms in the lower-cased (A-Z) url,
a hit counts only between boundaries (the url's edge or a character other than
a-z and 0-9), and the url is blocked on one strict hit or when the distinct
soft hits weigh at least ``soft_limit``.

Nulls: a null url, or one without ``://``, has an empty host and path; a null
url has no terms and is allowed.  Repeated rows are all kept; an empty table
gives an empty result; only the id and url columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default vocabulary by topic: terms that reject alone, and what others weigh.  About 1 for a term that is
#: seldom in a harmless url, less for one that often is, more for one that nearly tells by itself.
VOCABULARY = {
    "adult": (
        ("adult", "porn", "porno", "pornhub", "xxx", "escort", "escorts", "hentai", "nsfw", "camgirl", "camgirls", "milf", "hardcore", "sexcam", "sexcams", "fetish", "bdsm", "stripchat", "onlyfans", "incest"),
        {"sex": 1.0, "sexy": 1.25, "girls": 1.0, "hot": 1.0, "dating": 1.0, "hookup": 1.5, "hookups": 1.5, "singles": 0.75, "nude": 1.75, "nudes": 1.75, "naked": 1.5, "erotic": 1.75, "erotica": 1.5, "lingerie": 0.75, "webcam": 0.5, "webcams": 0.75, "cams": 1.0, "babes": 1.5, "teens": 0.75, "swingers": 1.75, "kinky": 1.5, "lust": 1.0, "massage": 0.5, "topless": 1.5, "mature": 0.5},
    ),
    "gambling": (
        ("casino", "casinos", "sportsbook", "sportsbooks", "bookmaker", "bookmakers", "togel", "sbobet"),
        {"bet": 1.0, "bets": 1.0, "betting": 1.0, "bonus": 1.0, "poker": 1.0, "win": 1.0, "slots": 1.25, "slot": 0.75, "jackpot": 1.5, "jackpots": 1.5, "roulette": 1.25, "blackjack": 1.25, "baccarat": 1.5, "lottery": 0.75, "lotto": 1.0, "gambling": 1.5, "gamble": 1.25, "wager": 1.0, "wagering": 1.25, "odds": 0.5, "freespins": 1.75, "spins": 1.0, "bingo": 0.75, "payout": 0.75, "payouts": 0.75, "parlay": 1.0, "stake": 0.5, "deposit": 0.5},
    ),
    "medicine": (
        ("viagra", "cialis", "levitra", "tramadol", "xanax", "oxycontin", "phentermine", "sildenafil", "tadalafil"),
        {"pills": 1.0, "pill": 0.75, "cheap": 1.0, "pharmacy": 0.75, "pharma": 0.5, "rx": 0.75, "prescription": 0.5, "steroids": 1.5, "steroid": 1.0, "hgh": 1.5, "enlargement": 1.75, "testosterone": 0.75, "slimming": 1.0, "weightloss": 1.25, "detox": 0.5, "keto": 0.5, "cbd": 0.75, "kratom": 1.25, "vape": 0.75, "supplement": 0.5, "supplements": 0.5, "nootropic": 0.75},
    ),
    "money": (
        ("payday", "paydayloan", "paydayloans", "ponzi"),
        {"loan": 1.0, "loans": 1.0, "credit": 0.5, "debt": 0.5, "mortgage": 0.5, "forex": 1.25, "binary": 0.25, "crypto": 0.75, "airdrop": 1.25, "giveaway": 1.0, "cash": 0.75, "cashback": 0.75, "rich": 0.75, "millionaire": 1.0, "earn": 0.75, "income": 0.5, "passive": 0.5, "profit": 0.75, "profits": 0.75, "refinance": 0.75, "insurance": 0.25, "invest": 0.25, "pips": 1.25, "hyip": 1.75, "mlm": 1.5},
    ),
    "piracy": (
        ("warez", "keygen", "keygens", "cracked", "torrentz", "thepiratebay"),
        {"crack": 1.25, "serial": 0.75, "torrent": 1.0, "torrents": 1.0, "nulled": 1.75, "rapidshare": 1.5, "megaupload": 1.5, "rip": 0.5, "dvdrip": 1.5, "bluray": 0.5, "putlocker": 1.75, "fullmovie": 1.5, "mp3": 0.5, "apk": 0.5, "modapk": 1.5, "unlocked": 0.75, "leaked": 1.0, "stream": 0.25, "streaming": 0.25, "hack": 0.75, "hacks": 1.0, "cheats": 0.75},
    ),
    "spam": (
        ("linkfarm", "doorway", "spamvertise"),
        {"ads": 1.0, "click": 1.0, "farm": 1.0, "free": 1.0, "game": 1.0, "spam": 1.0, "track": 1.0, "clickbait": 1.5, "adserver": 1.5, "doubleclick": 1.25, "popunder": 1.75, "popup": 0.75, "affiliate": 1.0, "affiliates": 1.0, "aff": 0.75, "referral": 0.5, "promo": 0.5, "coupon": 0.75, "coupons": 0.75, "discount": 0.5, "replica": 1.5, "replicas": 1.5, "rolex": 1.25, "outlet": 0.5, "seo": 0.5, "backlink": 1.5, "backlinks": 1.5, "traffic": 0.5, "tracker": 0.75, "redirect": 0.5, "sweepstakes": 1.5, "prize": 0.75, "winner": 0.75, "urgent": 0.75, "essay": 0.5, "essays": 0.75, "horoscope": 0.5, "followers": 0.75, "likes": 0.5},
    ),
}
STRICT = tuple(t for hard, _ in VOCABULARY.values() for t in hard)
SOFT = {t: w for _, easy in VOCABULARY.values() for t, w in easy.items()}
SOFT_LIMIT = 2.0
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_PLACE = re.compile(r"://([^/?#]*)([^?#]*)")


def host_path(url: str | None) -> tuple[str, str]:
    found = _PLACE.search(url) if url else None
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


class Rules:
    """Rules by host; a url is looked up by each suffix of its host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (None, None)
        at = 0
        while at >= 0 and host:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            at = host.find(".", at) + 1 or -1
        return best


def automaton(strict, soft):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term in strict:
        machine.add_word(term, (term, True, 0.0))
    for term, weight in dict(soft).items():
        machine.add_word(term, (term, False, weight))
    if len(machine):
        machine.make_automaton()
    return machine


def term_hits(machine, url: str | None) -> tuple[set[str], dict[str, float]]:
    """Distinct strict terms, and soft terms with their weights, between boundaries."""
    strict, soft = set(), {}
    if url and len(machine):
        low = url.translate(_FOLD)
        for end, (term, hard, weight) in machine.iter(low):
            start = end - len(term) + 1
            if (start and low[start - 1] in _ALNUM) or (end + 1 < len(low) and low[end + 1] in _ALNUM):
                continue
            if hard:
                strict.add(term)
            else:
                soft[term] = weight
    return strict, soft


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight) for each row."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        table, machine = Rules(rules), automaton(strict, soft)
        for batch in batches:
            out = {k: [] for k in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")}
            for url in batch.column(1).to_pylist():
                host, path = host_path(url)
                rule, verdict = table.match(host, path)
                hard, easy = term_hits(machine, url)
                weight = float(sum(easy.values()))
                row = (host, path, rule, verdict or ("block" if hard or (len(easy) > 1 and weight >= soft_limit) else "allow"), len(hard), len(easy), weight)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            yield pa.record_batch([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=[batch.schema.names[0], *out])

    return pages.select(F.col(id_col), F.col(url_col).alias("url")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    values = ", ".join([f"('{t}', true, 0.0)" for t in STRICT] + [f"('{t}', false, {w})" for t, w in SOFT.items()])
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH vocabulary(term, hard, weight) AS (VALUES {values}),
    cut AS (SELECT row_number() OVER () AS r, page_id, url,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    words AS (SELECT r, unnest(list_distinct(string_split_regex({low}, '[^a-z0-9]+'))) AS term FROM cut WHERE url IS NOT NULL),
    found AS (SELECT r, CAST(count(*) FILTER (hard) AS INT) AS n_strict, CAST(count(*) FILTER (NOT hard) AS INT) AS n_soft, CAST(sum(weight) AS DOUBLE) AS soft_weight FROM words JOIN vocabulary USING (term) GROUP BY r),
    hits AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)} END AS rule,
        CASE {' '.join(f"WHEN {fits(r)} THEN '{v}'" for r, v in longest)} END AS ruled,
        coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(soft_weight, 0) AS soft_weight FROM cut LEFT JOIN found USING (r))
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR (n_soft > 1 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
        n_strict, n_soft, soft_weight FROM hits"""


ORACLE_SQL = _sql()
