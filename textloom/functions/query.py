"""Understanding one query string: expansion, intents, boosts. Runs on the driver,
as a query is a scalar; :mod:`textloom.operators.ranking` applies the results to tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Expansion terms by word.
EXPANSIONS = {
    # authentication and security
    "auth": "authentication authorize authorization login logout session token",
    "authentication": "auth authorize login session token",
    "login": "authentication auth signin sign-in session",
    "logout": "signout sign-out authentication session",
    "oauth": "oauth2 authentication authorization token",
    "jwt": "jsonwebtoken token authentication bearer",
    "token": "jwt bearer authentication session",
    "password": "pwd passwd credentials secret hash",
    "credential": "credentials password secret key",
    "permission": "permissions authorization access role",
    "role": "roles permission access rbac acl",
    "security": "auth authentication secure encryption",
    # database and storage
    "db": "database data storage query",
    "database": "db data storage query sql",
    "sql": "database query select insert update delete",
    "query": "sql database search find filter",
    "mongo": "mongodb database nosql document",
    "mongodb": "mongo database nosql document collection",
    "postgres": "postgresql database sql relational",
    "postgresql": "postgres database sql relational",
    "mysql": "database sql relational",
    "redis": "cache database key-value store",
    "cache": "redis caching store memory",
    "orm": "database model entity repository",
    "prisma": "orm database model schema",
    "sequelize": "orm database model query",
    "typeorm": "orm database entity repository",
    "migration": "database schema migrate",
    "schema": "database model structure definition",
    # api and http
    "api": "endpoint route request response rest",
    "endpoint": "api route url path handler",
    "route": "router endpoint path url handler",
    "http": "https request response get post put delete",
    "https": "http request response secure ssl tls",
    "rest": "restful api endpoint request response",
    "graphql": "api query mutation schema resolver",
    "grpc": "rpc protocol service",
    "websocket": "socket ws realtime connection",
    "request": "req http fetch call",
    "response": "res http result reply",
    "middleware": "handler interceptor filter",
    "controller": "handler route endpoint",
    "fetch": "request http api call get",
    "axios": "http request fetch client",
    # async and concurrency
    "async": "asynchronous await promise",
    "await": "async promise asynchronous",
    "promise": "async await then catch",
    "sync": "synchronous blocking",
    "callback": "function handler async",
    "concurrent": "concurrency parallel async thread",
    "parallel": "concurrent async thread worker",
    "thread": "threading concurrent parallel worker",
    "worker": "thread background job task",
    # errors and exceptions
    "err": "error exception failure",
    "error": "err exception failure bug issue",
    "exception": "error catch throw try",
    "catch": "try exception error handle",
    "throw": "exception error raise",
    "fail": "failure error exception reject",
    "failure": "fail error exception reject",
    "bug": "error issue defect problem",
    "fix": "bug repair resolve patch",
    "handle": "handler process manage catch",
    "validate": "validation check verify assert",
    "validation": "validate check verify assertion",
    # configuration and settings
    "config": "configuration settings options setup",
    "configuration": "config settings options setup",
    "settings": "config configuration options preferences",
    "options": "config settings parameters arguments",
    "env": "environment variable dotenv",
    "environment": "env variable dotenv",
    "setup": "config configuration initialize init",
    "param": "parameter argument option",
    "parameter": "param argument option input",
    "arg": "argument parameter option input",
    "argument": "arg parameter option input",
    # common abbreviations
    "util": "utility helper utils",
    "utils": "utility helper util",
    "utility": "util utils helper",
    "fn": "function method",
    "func": "function method procedure",
    "var": "variable",
    "impl": "implementation implement",
    "init": "initialize initialization setup",
    "msg": "message",
    "req": "request",
    "res": "response result",
    "ctx": "context",
    "src": "source",
    "dest": "destination target",
    "dir": "directory folder path",
    "tmp": "temporary temp",
    "temp": "temporary tmp",
    "str": "string text",
    "num": "number integer",
    "int": "integer number",
    "bool": "boolean",
    "obj": "object",
    "arr": "array list",
    "len": "length size count",
    "idx": "index",
    "ptr": "pointer reference",
    "ref": "reference pointer",
    "doc": "document documentation",
    "docs": "documentation document",
    # programming concepts
    "class": "object type struct",
    "object": "class instance struct",
    "method": "function procedure",
    "function": "method procedure func fn",
    "property": "attribute field member",
    "attribute": "property field member",
    "field": "property attribute member",
    "interface": "type contract abstract",
    "type": "interface typedef definition",
    "struct": "structure class type record",
    "enum": "enumeration constant",
    "import": "require include module",
    "export": "module public expose",
    "module": "package library",
    "package": "module library dependency",
    "return": "result output yield",
    "loop": "iterate for while foreach",
    "iterate": "loop for while foreach",
    "condition": "if else branch switch",
    "array": "list collection vector",
    "list": "array collection",
    "map": "dictionary hash object",
    "set": "collection unique",
    "string": "text char",
    "number": "integer float numeric",
    "boolean": "bool true false",
    "null": "nil undefined none",
    "undefined": "null nil none",
    # testing
    "test": "testing spec unittest",
    "testing": "test spec unittest",
    "spec": "test specification",
    "mock": "mocking stub fake spy",
    "stub": "mock fake spy",
    "spy": "mock stub fake",
    "assert": "assertion expect should",
    "expect": "assert assertion should",
    "fixture": "test data setup",
    "unit": "unittest test spec",
    "integration": "test integration-test",
    "e2e": "end-to-end test",
    # logging and debugging
    "log": "logging logger debug",
    "logger": "log logging debug",
    "logging": "log logger debug trace",
    "debug": "debugging log trace",
    "trace": "log debug tracking",
    "print": "output display log",
    "console": "log debug output",
    # files
    "file": "path filesystem fs",
    "path": "file directory folder",
    "fs": "filesystem file path",
    "read": "load get fetch",
    "write": "save store output",
    "save": "write store persist",
    "load": "read get fetch",
    "parse": "parsing parser analyze",
    "serialize": "serialization json stringify",
    "deserialize": "parse json",
    # networking
    "socket": "websocket tcp connection",
    "tcp": "socket network connection",
    "udp": "network datagram",
    "ip": "address network",
    "port": "network socket listen",
    "connect": "connection socket network",
    "connection": "connect socket network",
    "client": "consumer connection",
    "server": "service backend host",
    "host": "server address url",
    "url": "uri address endpoint",
    "uri": "url address",
}
MAX_EXPANSION_TERMS = 10

# Keywords, patterns (tested on the lower-cased query) and base confidence by intent.
INTENTS = {
    "function": (
        "function method def fn func procedure subroutine lambda arrow callback handler helper utility util",
        [r"how.*work", r"implement.*", r"algorithm.*", r"calculate.*", r"compute.*", r"process.*"],
        0.7,
    ),
    "class": (
        "class struct type interface trait protocol object model entity component module service factory builder singleton abstract inheritance extends implements",
        [r"[A-Z][a-z]+[A-Z]"],
        0.7,
    ),
    "error": (
        "error exception catch throw try finally handle handling fail failure reject reject invalid validation validate",
        [r"handle.*error", r"exception.*handling", r"error.*handling"],
        0.8,
    ),
    "database": (
        "database db query sql mongo mongodb postgres postgresql mysql sqlite redis orm model schema table collection migration seed connection repository prisma sequelize typeorm knex",
        [r"find.*by", r"get.*from", r"insert.*into", r"update.*set", r"delete.*from"],
        0.8,
    ),
    "api": (
        "api endpoint route router request response http https rest restful graphql grpc websocket socket get post put patch delete middleware controller handler fetch axios",
        [r"rest.*api", r"api.*endpoint", r"http.*request"],
        0.75,
    ),
    "auth": (
        "auth authentication authorization login logout signup signin password token jwt oauth oauth2 session cookie permission role rbac acl credentials user principal identity sso",
        [r"authenticate.*", r"verify.*token", r"check.*permission"],
        0.85,
    ),
    "test": (
        "test spec mock stub spy assert expect should describe it beforeEach afterEach beforeAll afterAll jest mocha vitest chai fixture coverage unit integration e2e",
        [r"unit.*test", r"integration.*test", r"test.*case"],
        0.85,
    ),
    "config": (
        "config configuration settings options env environment dotenv variable constant constant parameter prop props properties yaml json toml ini",
        [r"load.*config", r"get.*setting", r"read.*env"],
        0.7,
    ),
}
ACTION_WORDS = frozenset("find search get show list how what where when create build make handle process manage implement".split())
# Boosts by chunk type under each profile.
TYPE_BOOSTS = {
    "class": {"class": 1.3, "function": 1.05, "method": 1.05, "module": 0.9, "other": 1.0},
    "entity": {"class": 1.15, "function": 1.1, "method": 1.1, "module": 0.92, "other": 1.0},
    "function": {"class": 1.05, "function": 1.15, "method": 1.15, "module": 0.95, "other": 1.0},
    "test": {"class": 1.1, "function": 1.2, "method": 1.2, "module": 0.95, "other": 1.0},
    "default": {"class": 1.05, "function": 1.1, "method": 1.1, "module": 0.95, "other": 1.0},
}


@dataclass(frozen=True)
class Expansion:
    query: str
    expanded: str
    terms: tuple[str, ...] = ()
    applied: tuple[str, ...] = ()


def expand(query: str, custom: dict[str, str] | None = None, most: int = MAX_EXPANSION_TERMS, enabled: bool = True) -> Expansion:
    """The query with the terms of its words' expansions behind it: no word of the
    query, none twice, ``most`` at most (0: no limit). A blank query stays as it is."""
    trimmed = query.strip()
    if not enabled or not trimmed:
        return Expansion(query, query)
    known = EXPANSIONS | (custom or {})
    words = trimmed.lower().split()
    applied = [w for w in words if known.get(w)]
    terms = list(dict.fromkeys(t for w in applied for t in known[w].split() if t not in set(words)))
    terms = terms[:most] if most else terms
    return Expansion(query, " ".join([trimmed, *terms]), tuple(terms), tuple(applied))


def has_expansion(word: str, custom: dict[str, str] | None = None) -> bool:
    return word.lower() in EXPANSIONS | (custom or {})


def expansion_terms(word: str, custom: dict[str, str] | None = None) -> list[str]:
    return (EXPANSIONS | (custom or {})).get(word.lower(), "").split()


def tokens(text: str) -> list[str]:
    """Lower-case ASCII words and numbers; camelCase, _ and - part words."""
    parted = re.sub(r"([a-z])([A-Z])", r"\1 \2", text)
    return re.findall("[a-z0-9]+", parted.replace("_", " ").replace("-", " ").lower())


def entity_like(query: str, query_tokens: list[str] | None = None) -> bool:
    """At most three tokens, no action word, and camelCase or at most two tokens."""
    found = tokens(query) if query_tokens is None else query_tokens
    if len(found) > 3 or ACTION_WORDS & set(found):
        return False
    return bool(re.search("[A-Z][a-z]+[A-Z]", query)) or len(found) <= 2


@dataclass(frozen=True)
class Match:
    category: str
    confidence: float
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Intent:
    query: str
    matches: tuple[Match, ...] = ()
    tokens: tuple[str, ...] = field(default=())

    @property
    def primary(self) -> str | None:
        return self.matches[0].category if self.matches else None

    def has(self, category: str, least: float = 0.0) -> bool:
        return any(m.category == category and m.confidence >= least for m in self.matches)


def half_up(x: float, digits: int = 2) -> float:
    """Rounded half up, as scores are shown."""
    import math

    return math.floor(x * 10**digits + 0.5) / 10**digits


def detect(query: str, least: float = 0.3, most: int = 3, custom: dict | None = None, enabled: bool = True) -> Intent:
    """Categories whose keywords or patterns the query has, surest first, ties in table order."""
    found = tuple(tokens(query))
    if not enabled:
        return Intent(query, (), found)
    low, out = query.lower(), []
    for category, (words, patterns, base) in (INTENTS | (custom or {})).items():
        hits = tuple(w for w in words.split() if w.lower() in found or re.search(rf"\b{re.escape(w.lower())}\b", low, re.ASCII))
        # the class pattern looks for capitals in a lower-cased query: it never matches
        matched = any(re.search(p, low, 0 if category == "class" else re.IGNORECASE) for p in patterns)
        if hits or matched:
            sure = min(1.0, base + 0.1 * (len(hits) - 1)) if len(hits) > 1 else base
            sure = half_up(min(1.0, sure + 0.15) if matched else sure)
            if sure >= least:
                out.append(Match(category, sure, hits))
    out.sort(key=lambda m: -m.confidence)
    return Intent(query, tuple(out[:most]), found)


def type_boosts(intent: Intent) -> dict[str, float]:
    """The first profile that fits: class, entity, function, test, default."""
    if "class" in intent.tokens or intent.primary == "class":
        return TYPE_BOOSTS["class"]
    if entity_like(intent.query, list(intent.tokens)):
        return TYPE_BOOSTS["entity"]
    return TYPE_BOOSTS[intent.primary if intent.primary in ("function", "test") else "default"]


_OPERATORS = re.compile(r'["*^]|\b(?:OR|AND|NOT|NEAR)\b')


@dataclass(frozen=True)
class TermQuery:
    """A keyword query: all of ``must``, one of each ``any_of`` set, none of ``never``;
    ``prefixes`` are terms to match by beginning, ``phrases`` words in a row, and
    ``near`` pairs of words at most so many words apart."""

    must: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    never: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    near: tuple[tuple[str, str, int], ...] = ()

    @property
    def positive(self) -> tuple[str, ...]:
        words = [*self.must, *(t for g in self.any_of for t in g), *(t for p in self.phrases for t in p), *(t for a, b, _ in self.near for t in (a, b))]
        return tuple(dict.fromkeys(words))


def parse_terms(query: str) -> TermQuery:
    """Words are all wanted; with operators in capitals or signs, ``a OR b`` wants one,
    ``NOT a`` none, ``a*`` a beginning, ``"a b"`` a phrase, ``NEAR(a b, 5)`` both close."""
    if not _OPERATORS.search(query):
        return TermQuery(must=tuple(dict.fromkeys(tokens_plain(query))))
    near, phrases = [], []

    def take_near(m):
        words = tokens_plain(m[1])
        near.append((words[0], words[1], int(m[2] or 10))) if len(words) >= 2 else None
        return " "

    rest = re.sub(r"NEAR\s*\(([^),]*)(?:,\s*(\d+))?\)", take_near, query)
    rest = re.sub(r'"([^"]*)"', lambda m: phrases.append(tuple(tokens_plain(m[1]))) or " ", rest)
    must, groups, never, prefixes = [], [], [], []
    parts = rest.replace("^", " ").split()
    k = 0
    while k < len(parts):
        part = parts[k]
        if part == "NOT" and k + 1 < len(parts):
            never += tokens_plain(parts[k + 1])
            k += 2
        elif k + 2 < len(parts) and parts[k + 1] == "OR":
            group = tokens_plain(part)
            while k + 2 < len(parts) and parts[k + 1] == "OR":
                group += tokens_plain(parts[k + 2])
                k += 2
            groups.append(tuple(dict.fromkeys(group)))
            k += 1
        else:
            if part.endswith("*"):
                prefixes += tokens_plain(part[:-1])
            elif part not in ("AND", "OR", "NOT", "NEAR"):
                must += tokens_plain(part)
            k += 1
    return TermQuery(tuple(dict.fromkeys(must)), tuple(groups), tuple(never), tuple(prefixes), tuple(p for p in phrases if p), tuple(near))


def tokens_plain(text: str) -> list[str]:
    """The tokens that the keyword index holds: lower-case ASCII words and numbers."""
    return re.findall("[a-z0-9]+", text.lower())
