"""Query planning: from a question to the phrases that the index is asked for.

Questions are short, so they are planned on the driver, one at a time; the plan is a table of leaves for bm25().
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import STOP_WORDS
from ..operators.rank import PROFILE, PROFILE_SUB, Boost

# Words that stand for each other, acronyms and what they stand for, and looser equivalents.
SYNONYMS = (
    ("spec", "specification", "specs"), ("auth", "authentication", "authorization", "oauth"), ("config", "configuration"), ("db", "database"),
    ("docs", "documentation"), ("k8s", "kubernetes"), ("js", "javascript"), ("ts", "typescript"), ("count", "counting"), ("deploy", "deployment"), ("new", "create"),
)
ACRONYMS = {
    "rls": "row level security", "mfa": "multi factor authentication", "cte": "common table expression", "tls": "transport layer security", "sso": "single sign on",
    "jwt": "json web token", "mcp": "model context protocol", "rbac": "role based access control", "crud": "create read update delete", "orm": "object relational mapping",
}
LOOSE = (
    ("return", "refund"), ("response", "output"), ("key", "secret", "credential"), ("commit", "rollback", "transaction"), ("roll", "rollback", "transaction"), ("connect", "link"),
    ("command", "cli"), ("rebuild", "reindex"), ("precomputed", "projection"), ("continue", "continues", "background", "asynchronous"), ("cite", "citation", "citations"),
    ("export", "dump"), ("inspect", "monitor", "monitoring"), ("property", "key", "keyof"), ("schedule", "cron"),
)
SURFACES = ("api", "cli", "client", "sdk")


@dataclass
class Config:
    """What a deployment knows: keywords of its sources, rewrites of questions (all of, one of, becomes), word classes."""

    source_keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rewrites: tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = ()
    synonyms: tuple[tuple[str, ...], ...] = SYNONYMS
    acronyms: dict[str, str] = field(default_factory=lambda: dict(ACRONYMS))
    loose: tuple[tuple[str, ...], ...] = LOOSE
    boosts: tuple[Boost, ...] = ()  # of sources' path prefixes
    profile_points: tuple[int, int] = (PROFILE, PROFILE_SUB)  # none below 0

    def others(self, token: str, classes: tuple[tuple[str, ...], ...]) -> list[str]:
        return list(dict.fromkeys(o for c in classes if token in c for o in c if o != token))


def tokenize(q: str) -> list[str]:
    return re.sub(r"[^\w-]|[^\S ]", " ", q.lower()).split()


def without_stop_words(tokens: list[str]) -> list[str]:
    return [t for t in tokens if t not in STOP_WORDS] or tokens


def scoring_tokens(q: str, exact: bool = False) -> list[str]:
    """The tokens that score titles and paths: `use` counts beside `tool`; an exact query keeps all."""
    tokens = tokenize(q)
    if exact:
        return tokens
    return [t for t in tokens if t not in STOP_WORDS or t == "use" and any(x in ("tool", "tools") for x in tokens)] or tokens


def rewrite(tokens: list[str], config: Config) -> list[str]:
    """The first rewrite whose words all occur, and one of its alternatives if it has any; else the tokens."""
    there = set(tokens)
    for need, one_of, becomes in config.rewrites:
        if there.issuperset(need) and (not one_of or there & set(one_of)):
            return list(becomes)
    return tokens


def intended_sources(tokens: list[str], config: Config) -> tuple[list[str], list[str]]:
    """The sources whose keywords (of one or more tokens) occur, and the tokens without those keywords."""
    sources: list[str] = []
    gone: set[int] = set()
    for key, names in config.source_keywords.items():
        words = tokenize(key)
        for i in range(len(tokens) - len(words) + 1):
            if words and tokens[i : i + len(words)] == words:
                sources += names
                gone.update(range(i, i + len(words)))
    return list(dict.fromkeys(sources)), [t for i, t in enumerate(tokens) if i not in gone]


def strong_source(tokens: list[str], config: Config) -> str | None:
    """The one source that a question names first, or before a word like api or sdk."""
    for i, t in enumerate(tokens[:-1]):
        names = config.source_keywords.get(t, ())
        if tokens[i + 1] in SURFACES and len(names) == 1:
            return names[0]
    names = config.source_keywords.get(tokens[0], ()) if tokens else ()
    return names[0] if len(names) == 1 and len(tokens) > 1 else None


def _phrase(token: str) -> list[str]:
    """The index splits at what is no letter or digit, so a token may be a phrase."""
    return re.sub(r"[^\w]|_", " ", token).split()


Leaf = tuple[int, int, list[str]]  # branch, group, terms


def strict_leaves(tokens: list[str], config: Config, exact: bool = False, branch: int = 0) -> list[Leaf]:
    """All tokens must occur, each itself or one of its synonyms; an exact query is one phrase."""
    if exact:
        terms = [w for t in tokens for w in _phrase(t)]
        return [(branch, 0, terms)] if terms else []
    out: list[Leaf] = []
    for g, t in enumerate(tokens):
        choices = [t, *config.others(t, config.synonyms), *([config.acronyms[t]] if t in config.acronyms else [])]
        out += [(branch, g, terms) for c in choices if (terms := [w for part in c.split() for w in _phrase(part)])]
    return out


def surface_leaves(tokens: list[str], config: Config, exact: bool = False) -> list[Leaf]:
    """For titles and paths: the tokens without source keywords, or the phrase that an acronym among them stands for."""
    left = intended_sources(tokens, config)[1] or tokens
    out = strict_leaves(left, config, exact)
    if not exact:
        for b, t in enumerate((t for t in left if t in config.acronyms), start=1):
            out.append((b, 0, config.acronyms[t].split()))
    return out


def relaxed_leaves(tokens: list[str], config: Config) -> list[Leaf]:
    """For questions of four tokens or more: any token, or a looser equivalent, is enough."""
    left = intended_sources(tokens, config)[1]
    if len(tokens) < 4:
        return []
    words = dict.fromkeys(w for t in left for w in (t, *config.others(t, config.synonyms), *config.others(t, config.loose)))
    return [(b, 0, terms) for b, w in enumerate(words) if (terms := _phrase(w))]


@dataclass
class Plan:
    qid: int
    leaves: dict[str, list[Leaf]]
    sources: dict[str, str | None]
    scoring: list[str]
    synonymed: list[str]
    concepts: list[list[str]]
    intended: list[str]
    strong: str | None
    text: str


def plan(qid: int, q: str, source: str | None = None, config: Config | None = None, exact: bool = False) -> Plan:
    """What each tier asks for. Tiers: title, path, body, strong (body of the one source meant), relaxed, relaxed_body.

    relaxed_body is relaxed in bodies too, for the source that is given or strongly meant.
    """
    config = config or Config()
    raw = tokenize(q)
    tokens = raw if exact else rewrite(without_stop_words(raw), config)
    intended, _ = intended_sources(tokens, config)
    strong = None if source or exact else strong_source(tokens, config)
    inferred = intended[0] if len(intended) == 1 else None
    body = [t for t in tokens if source is None or source not in config.source_keywords.get(t, ()) and t != source] or tokens
    leaves = {"title": surface_leaves(tokens, config, exact), "path": surface_leaves(tokens, config, exact), "body": strict_leaves(body, config, exact)}
    sources = {"title": source or inferred, "path": source or inferred, "body": source}
    if strong:
        leaves["strong"], sources["strong"] = strict_leaves([t for t in tokens if strong not in config.source_keywords.get(t, ())] or tokens, config), strong
    if not exact and (loose := relaxed_leaves(tokens, config)):
        leaves["relaxed"], sources["relaxed"] = loose, source or strong or inferred
        if source or strong:
            leaves["relaxed_body"], sources["relaxed_body"] = loose, source or strong
    scoring = [t for t in scoring_tokens(q, exact) if t != source] or scoring_tokens(q, exact)
    concepts = [[t, *config.others(t, config.synonyms), *config.others(t, config.loose)] for t in intended_sources(tokens, config)[1]]
    synonymed = [t for t in scoring if config.others(t, config.synonyms)]
    return Plan(qid, leaves, sources, scoring, synonymed, concepts, intended, strong, q.lower())


def leaf_rows(plans: list[Plan]) -> list[tuple]:
    """Rows of bm25.LEAF_SCHEMA; equal phrases of a tier share a leaf."""
    rows = []
    for p in plans:
        for tier, leaves in p.leaves.items():
            numbers: dict[tuple[str, ...], int] = {}
            for branch, grp, terms in leaves:
                leaf = numbers.setdefault(tuple(terms), len(numbers))
                rows.append((p.qid, tier, branch, grp, leaf, terms, p.sources[tier]))
    return rows
