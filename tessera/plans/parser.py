"""Text to statements: a scanner and a recursive-descent parser.

Beyond the base grammar it takes parentheses around conditions, NOT-free nesting of AND and OR,
the word OUTER, and ASC/DESC on any key.
"""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from tessera.errors import EngineError, ParseError
from tessera.functions import geo, vectors
from tessera.plans import ast as A

_LEX = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<op><=|>=|<>|!=|==|[-+()\[\],.*=<>;@])""",
    re.S | re.X,
)
INDEX_KINDS = {
    "HASH": "hash",
    "EXTENDIBLE_HASH": "hash",
    "BPLUS": "bplus_unclustered",
    "BPLUS_UNCLUSTERED": "bplus_unclustered",
    "UNCLUSTERED": "bplus_unclustered",
    "BPLUS_CLUSTERED": "bplus_clustered",
    "CLUSTERED": "bplus_clustered",
    "RTREE": "rtree",
    "R_TREE": "rtree",
    "GIST": "rtree",
    "IVF": "ivf",
}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
_RESERVED = frozenset("SELECT FROM WHERE GROUP ORDER BY LIMIT USING JOIN INNER LEFT RIGHT FULL OUTER ON AND OR AS HAVING UNION SET VALUES INTO".split())


class Token(NamedTuple):
    kind: str
    text: str
    at: int


def scan(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise ParseError(f"unexpected character at {at}: {source[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def split_statements(source: str) -> list[str]:
    """The statements of a script, without empty ones."""
    out, start = [], 0
    for t in scan(source):
        if t.kind == "op" and t.text == ";":
            out.append(source[start : t.at])
            start = t.at + 1
    out.append(source[start:])
    return [s.strip() for s in out if scan(s)]


def parse(source: str) -> Any:
    """One statement; what follows a semicolon is not looked at."""
    return Parser(source).statement()


class Parser:
    def __init__(self, source: str):
        tokens = scan(source)
        end = next((i for i, t in enumerate(tokens) if t.text == ";" and t.kind == "op"), len(tokens))
        self.tokens, self.at = tokens[:end], 0
        if not self.tokens:
            raise ParseError("empty statement")

    # -- small steps

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", -1)

    def word(self, ahead: int = 0) -> str:
        t = self.peek(ahead)
        return t.text.upper() if t.kind == "word" else ""

    def accept(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def symbol(self, text: str) -> bool:
        t = self.peek()
        if t.kind == "op" and t.text == text:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.accept(*words):
            raise ParseError(f"expected {' '.join(words)}, found {self.peek().text or 'the end'}")

    def need_symbol(self, text: str) -> None:
        if not self.symbol(text):
            raise ParseError(f"expected {text}, found {self.peek().text or 'the end'}")

    def ident(self) -> str:
        t = self.peek()
        if t.kind != "word":
            raise ParseError(f"expected a name, found {t.text or 'the end'}")
        self.at += 1
        return t.text.lower()

    def name(self) -> A.Name:
        first = self.ident()
        return A.Name(self.ident(), first) if self.symbol(".") else A.Name(first)

    def number(self) -> float | int:
        sign = -1 if self.symbol("-") else 1
        if sign == 1:
            self.symbol("+")
        t = self.peek()
        if t.kind != "number":
            raise ParseError(f"expected a number, found {t.text or 'the end'}")
        self.at += 1
        return sign * (int(t.text) if t.text.isdigit() else float(t.text))

    def integer(self) -> int:
        n = self.number()
        if not isinstance(n, int):
            raise ParseError("expected a whole number")
        return n

    def text(self) -> str:
        t = self.peek()
        if t.kind != "text":
            raise ParseError(f"expected text in quotes, found {t.text or 'the end'}")
        self.at += 1
        return t.text[1:-1].replace(t.text[0] * 2, t.text[0])

    def literal(self) -> Any:
        t = self.peek()
        if t.kind == "text":
            return self.text()
        if t.kind == "number" or t.kind == "op" and t.text in "+-":
            return self.number()
        if t.kind == "op" and t.text == "[":
            return "[" + ", ".join(str(x) for x in self.vector()) + "]"
        if t.kind == "word":  # a bare word is text
            self.at += 1
            return {"NULL": None, "TRUE": True, "FALSE": False}.get(t.text.upper(), t.text)
        raise ParseError(f"expected a value, found {t.text or 'the end'}")

    def vector(self) -> list[float]:
        self.need_symbol("[")
        out = [self.number()]
        while self.symbol(","):
            out.append(self.number())
        self.need_symbol("]")
        return [float(x) for x in out]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise ParseError(f"unexpected {self.peek().text}")

    # -- statements

    def statement(self) -> Any:
        made = self._statement()
        self.end()
        return made

    def _statement(self) -> Any:
        if self.accept("EXPLAIN"):
            analyze = self.accept("ANALYZE")
            return A.Explain(self._statement(), analyze)
        if self.accept("SELECT"):
            return self.select()
        if self.accept("INSERT", "INTO"):
            return self.insert()
        if self.accept("UPDATE"):
            return self.update()
        if self.accept("DELETE", "FROM"):
            return A.Delete(self.ident(), self.where())
        if self.accept("CREATE", "TABLE"):
            return self.create_table()
        if self.accept("DROP", "TABLE"):
            there = self.accept("IF", "EXISTS")
            return A.DropTable(self.ident(), there)
        if self.word() == "CREATE" and self.word(1) in ("UNIQUE", "INDEX"):
            return self.create_index()
        if self.accept("DROP", "INDEX"):
            there = self.accept("IF", "EXISTS")
            name = self.ident()
            return A.DropIndex(name, self.ident() if self.accept("ON") else None, there)
        if self.accept("SET"):
            name = self.ident()
            self.need_symbol("=")
            return A.SetPoint(name, self.point())
        for words, action in ((("BEGIN",), "begin"), (("START",), "begin"), (("END",), "commit"), (("COMMIT",), "commit"), (("ROLLBACK",), "rollback")):
            if self.accept(*words):
                if not self.accept("TRANSACTION"):
                    self.accept("WORK")
                return A.Transaction(action)
        raise ParseError(f"unknown statement: {self.peek().text}")

    def select(self) -> A.Select:
        items = [self.item()]
        while self.symbol(","):
            items.append(self.item())
        self.need("FROM")
        table = self.ident()
        joins = []
        while (how := self.join_kind()) is not None:
            right = self.ident()
            self.need("ON")
            left_name = self.name()
            self.need_symbol("=")
            right_name = self.name()
            if left_name.table == right and right_name.table != right:
                left_name, right_name = right_name, left_name
            joins.append(A.Join(how, right, left_name, right_name))
        where = self.where()
        using = metric = None
        if self.accept("USING"):
            using = self.ident().replace("tfidf", "tf_idf")
            if using not in ("hnsw", "ivf", "tf_idf", "bm25"):
                raise ParseError(f"unknown technique: {using}")
            if self.accept("WITH"):
                if using in ("tf_idf", "bm25"):
                    raise ParseError("WITH METRIC goes with HNSW or IVF")
                metric = self.metric()
        group: list[A.Name] = []
        if self.accept("GROUP"):
            self.need("BY")
            group.append(self.name())
            while self.symbol(","):
                group.append(self.name())
        if self.word() == "HAVING":
            raise ParseError("HAVING is not supported")
        order: list[A.Key] = []
        if self.accept("ORDER"):
            self.need("BY")
            order.append(self.key())
            while self.symbol(","):
                order.append(self.key())
        limit = None
        if self.accept("LIMIT"):
            limit = self.integer()
            if limit < 0:
                raise ParseError("LIMIT must not be negative")
        made = A.Select(tuple(items), table, tuple(joins), where, using, metric, tuple(group), tuple(order), limit)
        _check_search(made)
        return made

    def join_kind(self) -> str | None:
        for word in ("INNER", "LEFT", "RIGHT", "FULL"):
            if self.word() == word:
                self.at += 1
                if word != "INNER":
                    self.accept("OUTER")
                self.need("JOIN")
                return word.lower()
        return "inner" if self.accept("JOIN") else None

    def metric(self) -> str:
        self.need("METRIC")
        self.need_symbol("=")
        try:
            return vectors.metric_name(self.ident())
        except EngineError as e:
            raise ParseError(str(e)) from e

    def alias(self) -> str | None:
        return self.ident() if self.accept("AS") else None

    def item(self) -> A.Item:
        if self.symbol("*"):
            return A.Item("star")
        if self.word() in AGGREGATES and self.peek(1).text == "(":
            function = self.ident()
            self.need_symbol("(")
            name = None if self.symbol("*") else A.Name(self.ident())
            self.need_symbol(")")
            if name is None and function != "count":
                raise ParseError(f"{function}(*) is not defined")
            return A.Item("aggregate", name, function, self.alias())
        if self.word() in ("SCORE", "SIMILARITY_SCORE") and self.peek(1).text == "(":
            self.at += 1
            self.need_symbol("(")
            self.need_symbol(")")
            return A.Item("score", alias=self.alias() or "score")
        if self.word() in _RESERVED:
            raise ParseError(f"expected a column, found {self.peek().text}")
        return A.Item("column", self.name())

    def key(self) -> A.Key:
        by = self.distance() if self.is_distance() else self.name()
        down = self.accept("DESC")
        if not down:
            self.accept("ASC")
        return A.Key(by, down)

    # -- conditions

    def where(self) -> Any:
        return self.any_of() if self.accept("WHERE") else None

    def any_of(self) -> Any:
        parts = [self.all_of()]
        while self.accept("OR"):
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else A.Any_(tuple(parts))

    def all_of(self) -> Any:
        parts = [self.condition()]
        while self.accept("AND"):
            parts.append(self.condition())
        return parts[0] if len(parts) == 1 else A.All_(tuple(parts))

    def is_distance(self) -> bool:
        return self.word() in ("DISTANCIA", "DISTANCE") and self.peek(1).text == "("

    def condition(self) -> Any:
        if self.symbol("("):
            inner = self.any_of()
            self.need_symbol(")")
            return inner
        called = self.peek(1).text == "("
        if self.is_distance():
            left = self.distance()
            op = self.peek().text
            if op not in ("<", "<="):
                raise ParseError("a distance is compared with < or <=")
            self.at += 1
            return A.Compare(left, op, float(self.number()))
        if called and self.word() in ("DENTRO_DE", "WITHIN", "DENTRO"):
            return self.inside()
        if called and self.word() == "MATCH":
            self.at += 2
            column = self.name().column
            self.need_symbol(",")
            query = self.text()
            self.need_symbol(")")
            if not query.strip():
                raise ParseError("MATCH needs a text")
            return A.Match(column, query)
        if called and self.word() == "SIMILAR_TO":
            return self.similar()
        left = self.name()
        if self.accept("BETWEEN"):
            low = self.literal()
            self.need("AND")
            return A.Between(left, low, self.literal())
        op = self.peek().text
        if self.peek().kind != "op" or op not in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            raise ParseError(f"expected a comparison, found {op or 'the end'}")
        self.at += 1
        return A.Compare(left, {"==": "=", "<>": "!="}.get(op, op), self.literal())

    def point(self) -> tuple[float, float]:
        self.need("POINT")
        self.need_symbol("(")
        lat = self.number()
        self.need_symbol(",")
        lon = self.number()
        self.need_symbol(")")
        try:
            return geo.check_point(lat, lon)
        except EngineError as e:
            raise ParseError(str(e)) from e

    def distance(self) -> A.Distance:
        self.at += 1
        self.need_symbol("(")
        column = self.name().column
        self.need_symbol(",")
        self.symbol("@")
        target: Any = self.point() if self.word() == "POINT" and self.peek(1).text == "(" else self.ident()
        metric = "haversine"
        if self.symbol(","):
            raw = self.text() if self.peek().kind == "text" else self.ident()
            try:
                metric = geo.metric_name(raw)
            except EngineError as e:
                raise ParseError(str(e)) from e
        self.need_symbol(")")
        return A.Distance(column, target, metric)

    def inside(self) -> A.Inside:
        self.at += 1
        self.need_symbol("(")
        column = self.name().column
        self.need_symbol(",")
        self.need("POLYGON")
        self.need_symbol("(")
        self.need_symbol("(")
        ring = [(float(self.number()), float(self.number()))]
        while self.symbol(","):
            ring.append((float(self.number()), float(self.number())))
        self.need_symbol(")")
        self.need_symbol(")")
        self.need_symbol(")")
        if len(ring) < 3:
            raise ParseError("a polygon needs three points")
        return A.Inside(column, tuple(ring))

    def similar(self) -> A.Similar:
        self.at += 1
        self.need_symbol("(")
        t = self.peek()
        if t.kind == "text":
            target: Any = self.text()
        elif t.text == "[":
            target = tuple(self.vector())
        else:
            target = self.name()
        k, column = 10, None
        while self.symbol(","):
            option = self.ident()
            self.need_symbol("=")
            if option == "k":
                k = self.integer()
            elif option == "column":
                column = self.ident()
            else:
                raise ParseError(f"unknown option: {option}")
        self.need_symbol(")")
        if k < 1:
            raise ParseError("k must be 1 or more")
        return A.Similar(target, k, column)

    # -- writes and definitions

    def value(self) -> Any:
        if self.word() in ("EXTRACT_FEATURES", "EXTRAER_CARACTERISTICAS") and self.peek(1).text == "(":
            self.at += 1
            self.need_symbol("(")
            file, kind = self.text(), None
            if self.symbol(","):
                kind = self.text().lower()
            self.need_symbol(")")
            return A.Features(file, kind)
        return self.literal()

    def insert(self) -> A.Insert:
        table = self.ident()
        self.need("VALUES")
        self.need_symbol("(")
        values = [self.value()]
        while self.symbol(","):
            values.append(self.value())
        self.need_symbol(")")
        return A.Insert(table, tuple(values))

    def update(self) -> A.Update:
        table = self.ident()
        self.need("SET")
        changes = []
        while True:
            column = self.ident()
            self.need_symbol("=")
            changes.append((column, self.value()))
            if not self.symbol(","):
                break
        return A.Update(table, tuple(changes), self.where())

    def type(self) -> A.Type:
        word = self.ident().upper()
        if word == "DOUBLE":
            self.accept("PRECISION")
        sizes = []
        if self.symbol("("):
            sizes.append(self.integer())
            if self.symbol(","):
                sizes.append(self.integer())
            self.need_symbol(")")
        if word in ("INT", "INTEGER", "SMALLINT", "SERIAL"):
            return A.Type("int")
        if word == "BIGINT":
            return A.Type("bigint")
        if word in ("FLOAT", "REAL", "DOUBLE", "DECIMAL", "NUMERIC"):
            return A.Type("double")
        if word in ("VARCHAR", "CHAR", "CHARACTER"):
            return A.Type("string", sizes[0] if sizes else None)
        if word in ("TEXT", "STRING", "CLOB"):
            return A.Type("string")
        raise ParseError(f"unsupported type: {word}")

    def create_table(self) -> A.CreateTable:
        missing = self.accept("IF", "NOT", "EXISTS")
        table = self.ident()
        self.need_symbol("(")
        columns: list[tuple[str, A.Type]] = []
        key = None
        while True:
            if self.accept("PRIMARY", "KEY"):
                self.need_symbol("(")
                key = self.ident()
                self.need_symbol(")")
            else:
                name = self.ident()
                columns.append((name, self.type()))
                while self.peek().text not in (",", ")", ""):  # NOT NULL, UNIQUE and the like change nothing
                    if self.accept("PRIMARY", "KEY"):
                        key = name
                    else:
                        self.at += 1
            if not self.symbol(","):
                break
        self.need_symbol(")")
        storage = "heap"
        if self.accept("USING"):
            storage = self.ident()
            if storage not in ("heap", "sequential"):
                raise ParseError("USING HEAP or USING SEQUENTIAL")
        names = [c for c, _ in columns]
        if not names or len(set(names)) != len(names):
            raise ParseError("columns are missing or repeated")
        if key is not None and key not in names:
            raise ParseError(f"unknown key column: {key}")
        return A.CreateTable(table, tuple(columns), key or names[0], storage, missing)

    def create_index(self) -> A.CreateIndex:
        self.need("CREATE")
        unique = self.accept("UNIQUE")
        self.need("INDEX")
        missing = self.accept("IF", "NOT", "EXISTS")
        name = None if self.word() == "ON" else self.ident()
        self.need("ON")
        table = self.ident()
        self.need_symbol("(")
        columns = [self.ident()]
        while self.symbol(","):
            columns.append(self.ident())
        self.need_symbol(")")
        kind, metric = "bplus_unclustered", None
        if self.accept("USING"):
            word = self.ident().upper()
            if word not in INDEX_KINDS:
                raise ParseError(f"unknown technique: {word}")
            kind = INDEX_KINDS[word]
            if self.accept("WITH"):
                if kind != "ivf":
                    raise ParseError("WITH METRIC goes with IVF")
                metric = self.metric()
        if len(columns) != (2 if kind == "rtree" else 1):
            raise ParseError("RTREE takes two columns, other techniques one")
        return A.CreateIndex(table, tuple(columns), kind, name, unique, missing, metric)


def walk(condition: Any, inside_or: bool = False):
    """Every leaf with whether it stands under an OR."""
    if isinstance(condition, (A.All_, A.Any_)):
        for p in condition.parts:
            yield from walk(p, inside_or or isinstance(condition, A.Any_))
    elif condition is not None:
        yield condition, inside_or


def _check_search(s: A.Select) -> None:
    found = [(c, o) for c, o in walk(s.where) if isinstance(c, (A.Match, A.Similar))]
    if len(found) > 1:
        raise ParseError("one MATCH or SIMILAR_TO in a query")
    if any(o for _, o in found):
        raise ParseError("MATCH and SIMILAR_TO go under AND only")
    if s.using:
        if not found:
            raise ParseError("USING needs MATCH or SIMILAR_TO")
        text = s.using in ("tf_idf", "bm25")
        if text != isinstance(found[0][0], A.Match):
            raise ParseError(f"{s.using} does not fit the predicate")
