"""Structural reading of C#: declarations by their heads, bodies by token patterns.

No semantic model is built. A file is read once, in source order: namespaces and types
open scopes, member heads are classified by their brackets, and bodies are scanned for the
token patterns of local declarations, object creation, calls, registrations and routes.
What needs other files (types of chained receivers) leaves as steps for the index.

Documented differences to a full compiler: overloads, extension methods, indexers as
receivers, pattern and foreach variables are not resolved; locals belong to the type, the
last declaration in source order holds; an unresolved local never becomes a target.
"""

from __future__ import annotations

import re
from typing import Any

from typegraph.extract.lexer import Tokens, closing, closing_angle, pieces, tokenize

# Names with a meaning for the graph.
HTTP_ATTRIBUTES = ("HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "HttpHead", "HttpOptions")
NOISE_TYPES = frozenset(
    (
        "Task", "ValueTask", "Task`1", "List", "IList", "IEnumerable", "ICollection",
        "IReadOnlyList", "IReadOnlyCollection", "IAsyncEnumerable", "Dictionary",
        "IDictionary", "IReadOnlyDictionary", "HashSet", "ISet", "Queue", "Stack",
        "Func", "Action", "Predicate", "Tuple", "ValueTuple", "Span", "ReadOnlySpan",
        "Memory", "ReadOnlyMemory", "Nullable", "Lazy", "Array",
        "string", "String", "int", "Int32", "long", "Int64", "bool", "Boolean",
        "double", "decimal", "float", "byte", "char", "object", "Object", "void",
        "Guid", "DateTime", "DateTimeOffset", "TimeSpan", "DateOnly", "TimeOnly",
        "CancellationToken",
    )
)
HANDLER_INTERFACES = (
    "IRequestHandler", "INotificationHandler", "IConsumer", "ICommandHandler",
    "IQueryHandler", "IStreamRequestHandler", "IRequestPreProcessor", "IRequestPostProcessor",
)
SEND_METHODS = ("Send", "Publish", "Enqueue", "Schedule", "PublishAsync", "SendAsync", "Dispatch")
BUS_HINTS = (
    "Mediator", "IMediator", "ISender", "IPublisher", "Bus", "IBus", "IPublishEndpoint", "ISendEndpoint",
    "MessageSession", "IMessageSession", "IBusControl", "IBusAdvancedApi", "Dispatcher", "IDispatcher",
)
LIFETIMES = {"Scoped": "scoped", "Singleton": "singleton", "Transient": "transient"}
MAP_METHODS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
NO_ELEMENT_TYPE = ("OfType", "Cast")  # generic calls that return a collection

_MODIFIERS = frozenset(
    "public private protected internal static abstract sealed virtual override readonly async partial extern new unsafe "
    "volatile required const file ref in out params this scoped event implicit explicit fixed".split()
)
_TYPE_WORDS = ("class", "interface", "record", "struct")
_NO_LOCAL = frozenset(
    "return throw await yield new else case goto in is as and or not when where select from orderby group let join on equals by "
    "using lock if while for foreach switch do try catch finally base this default typeof nameof sizeof out ref break continue "
    "checked unchecked stackalloc true false null var public private static".split()
)
_REGISTER = re.compile(r"^(?:Try|)Add(?:Keyed|)(Scoped|Singleton|Transient)$")


class _Reader:
    def __init__(self, path: str, tokens: Tokens):
        self.t = tokens
        self.out: dict[str, Any] = {
            "file_path": path, "usings": [], "aliases": {}, "nodes": [], "edges": [], "endpoints": [], "call_sites": [],
            "di_bindings": [], "members": [], "return_sigs": [], "pending_calls": [], "pending_locals": [], "failed": False,
        }
        self.ns: list[str] = []
        self.types: list[dict[str, Any]] = []
        self.member: str | None = None
        self.chains: dict[tuple[int, int], int] = {}
        self.walked: dict[int, tuple[int, list[dict[str, Any]]]] = {}

    # ---- small readers

    @property
    def namespace(self) -> str:
        return ".".join(self.ns)

    @property
    def owner(self) -> str | None:
        return self.types[-1]["name"] if self.types else None

    @property
    def locals(self) -> dict[str, str | None] | None:
        return self.types[-1]["locals"] if self.types else None

    def dotted(self, k: int, end: int) -> tuple[str, int]:
        """A dotted name at k and the index behind it."""
        parts = []
        while k < end and self.t[k].kind == "name":
            parts.append(self.t[k].text)
            if k + 1 < end and self.t[k + 1].text in (".", "::"):
                k += 2
            else:
                return ".".join(parts), k + 1
        return ".".join(parts), k

    def type_names(self, start: int, end: int) -> list[str]:
        """Meaningful names of a written type: containers are passed through."""
        names: list[str] = []
        k = start
        while k < end:
            tok = self.t[k]
            if tok.kind == "name" and tok.text not in _MODIFIERS:
                full, k = self.dotted(k, end)
                last = full.rsplit(".", 1)[-1]
                if last not in NOISE_TYPES and last not in ("var", "dynamic", "short", "uint", "ulong", "ushort", "sbyte", "nint"):
                    names.append(last)
            else:
                k += 1
        return names

    def parameters(self, start: int, end: int) -> list[tuple[int, int, str, int]]:
        """(type start, type end, name, line) of each parameter between two brackets."""
        found = []
        for a, b in pieces(self.t, start, end):
            while a < b and self.t[a].text == "[":
                a = closing(self.t, a, b) + 1
            while a < b and self.t[a].text in _MODIFIERS:
                a += 1
            stop = next((k for k in range(a, b) if self.t[k].text == "="), b)
            if stop - a >= 2 and self.t[stop - 1].kind == "name":
                found.append((a, stop - 1, self.t[stop - 1].text, self.t[a].line))
        return found

    # ---- rows

    def edge(self, to: str, relation: str, line: int, member: str | None = None, src: str | None = None, reverse: bool = False) -> None:
        """A relation of the type at hand, or of ``src``, to a written name; ``reverse`` for one of a written ``src`` to the type at hand."""
        src = src or self.owner
        if src:
            self.out["edges"].append(
                {"from_type": src, "from_resolved": not reverse, "to_type": to, "to_resolved": reverse, "ns": self.namespace,
                 "relation": relation, "line": line, "from_member": member}
            )

    def refs(self, start: int, end: int, relation: str, line: int) -> None:
        for n in self.type_names(start, end):
            self.edge(n, relation, line)

    def local(self, name: str, start: int, end: int) -> None:
        names = self.type_names(start, end)
        if self.locals is not None and names:
            self.locals[name] = names[0]

    # ---- declarations

    def read(self) -> None:
        self.outside(0, len(self.t))

    def outside(self, k: int, end: int) -> None:
        """Namespace level: usings, namespaces, types; anything else is a body."""
        docs: list[str] = []
        while k < end:
            tok = self.t[k]
            if tok.kind == "doc":
                docs.append(tok.text)
                k += 1
                continue
            if tok.text == "global" and k + 1 < end and self.t[k + 1].text == "using":
                k += 1
                continue
            if tok.text == "using" and k + 1 < end and self.t[k + 1].text != "(" and self.t[k + 1].text != "var":
                semi = next((j for j in range(k, end) if self.t[j].text == ";"), end)
                a = k + 1 + (self.t[k + 1].text in ("static", "unsafe"))
                if a + 1 < semi and self.t[a + 1].text == "=":
                    self.out["aliases"][self.t[a].text] = "".join(x.text for x in self.t[a + 2 : semi])
                elif a < semi:
                    name, stop = self.dotted(a, semi)
                    if stop == semi:
                        self.out["usings"].append(name)
                k = semi + 1
            elif tok.text == "namespace":
                name, k = self.dotted(k + 1, end)
                self.ns.append(name)
                if k < end and self.t[k].text == "{":
                    stop = closing(self.t, k, end)
                    self.outside(k + 1, stop)
                    self.ns.pop()
                    k = stop
                k += 1  # a file-scoped namespace holds to the end
            elif (head := self.type_head(k, end)) is not None:
                k = self.type_declaration(k, head, end, docs)
            else:
                stop = next((j for j in range(k, end) if self.t[j].text in (";", "{")), end)
                if stop < end and self.t[stop].text == "{":
                    stop = closing(self.t, stop, end)
                self.body(k, min(stop + 1, end))
                k = stop + 1
            docs = []

    def type_head(self, k: int, end: int) -> int | None:
        """Index of class, interface, record or struct if a type declaration begins at k."""
        while k < end:
            if self.t[k].text == "[":
                k = closing(self.t, k, end) + 1
            elif self.t[k].text in _TYPE_WORDS and self.t[k].kind == "name":
                nxt = self.t[k + 1] if k + 1 < end else None
                return k if nxt and nxt.kind == "name" else None
            elif self.t[k].text in _MODIFIERS or self.t[k].kind == "doc":
                k += 1
            else:
                return None
        return None

    def attributes(self, k: int, stop: int) -> list[tuple[str, str | None]]:
        """(name, first string argument) of the attributes between k and stop."""
        found = []
        while k < stop:
            if self.t[k].text == "[":
                close = closing(self.t, k, stop)
                for a, b in pieces(self.t, k + 1, close):
                    if a + 1 < b and self.t[a + 1].text == ":":
                        a += 2
                    name, j = self.dotted(a, b)
                    arg = next((self.t[x].text for x in range(j, b) if self.t[x].kind == "string"), None)
                    found.append((name.rsplit(".", 1)[-1], None if arg is None else _plain(arg)))
                k = close
            k += 1
        return found

    def type_declaration(self, k: int, head: int, end: int, docs: list[str]) -> int:
        t = self.t
        attrs = self.attributes(k, head)
        public = any(x.text == "public" for x in t[k:head])
        first = next((j for j in range(k, head + 1) if t[j].kind != "doc"), head)
        kind = t[head].text.capitalize()
        at = head + 1
        if t[head].text == "record" and t[at].text in ("class", "struct"):
            at += 1
        simple = t[at].text
        at += 1
        if at < end and t[at].text == "<" and (c := closing_angle(t, at, end)) is not None:
            at = c + 1
        prefix = f"{self.owner}." if self.types else (f"{self.namespace}." if self.namespace else "")
        name = prefix + simple
        params: tuple[int, int] | None = None
        if at < end and t[at].text == "(":
            close = closing(t, at, end)
            params = (at + 1, close)
            at = close + 1
        base_start = at + 1 if at < end and t[at].text == ":" else None
        stop = at
        while stop < end and t[stop].text not in ("{", ";"):
            if t[stop].text in "([":
                stop = closing(t, stop, end)
            stop += 1
        body_end = closing(t, stop, end) if stop < end and t[stop].text == "{" else stop
        last = t[min(body_end, end - 1)].line
        route = next((v for a, v in attrs if a in ("Route", "RouteAttribute") and v is not None), None)
        if route is not None:
            route = route.replace("[controller]", re.sub("Controller$", "", simple))
        self.out["nodes"].append(
            {"name": name, "namespace": self.namespace, "kind": kind, "is_public": public, "start_line": t[first].line,
             "end_line": last, "summary": _summary(docs + [x.text for x in t[k:head] if x.kind == "doc"])}
        )
        self.types.append({"name": name, "simple": simple, "public": public, "route": route, "locals": {}})
        if params:
            for a, b, pname, line in self.parameters(*params):
                self.refs(a, b, "ctor-param", line)
                self.local(pname, a, b)
        if base_start is not None:
            where = next((j for j in range(base_start, stop) if t[j].text == "where" and t[j].kind == "name"), stop)
            for a, b in pieces(t, base_start, where):
                self.base_type(a, b)
        if body_end > stop:
            self.type_body(stop + 1, body_end)
        self.types.pop()
        if body_end + 1 < end and t[body_end].text == "}" and t[body_end + 1].text == ";":
            body_end += 1
        return body_end + 1

    def base_type(self, a: int, b: int) -> None:
        name, k = self.dotted(a, b)
        last = name.rsplit(".", 1)[-1]
        line = self.t[a].line
        args = self.type_names(k, b) if k < b and self.t[k].text == "<" else []
        if "." not in name and last in HANDLER_INTERFACES and args:
            self.edge(self.owner or "", "handled-by", line, src=args[0], reverse=True)
        for n in ([last] if last and last not in NOISE_TYPES else []) + args:
            looks = len(n) > 1 and n[0] == "I" and n[1].isupper()
            self.edge(n, "implements" if looks else "inherits", line)

    def type_body(self, k: int, end: int) -> None:
        docs: list[str] = []
        while k < end:
            if self.t[k].kind == "doc":
                docs.append(self.t[k].text)
                k += 1
            elif (head := self.type_head(k, end)) is not None:
                k = self.type_declaration(k, head, end, docs)
                docs = []
            elif self.t[k].text in (";", ",", "}"):
                k += 1
            else:
                k = self.member_declaration(k, end)
                docs = []

    def member_declaration(self, k: int, end: int) -> int:
        t = self.t
        first = k
        while k < end and t[k].text == "[":
            k = closing(t, k, end) + 1
        attrs = self.attributes(first, k)
        mods = k
        while k < end and t[k].text in _MODIFIERS and t[k].kind == "name":
            k += 1
        public = any(x.text == "public" for x in t[mods:k])
        start, at, paren = k, k, None
        while at < end and t[at].text not in (";", "{", "=>", "=", "}"):
            if t[at].text == "<" and (c := closing_angle(t, at, end)) is not None:
                at = c
            elif t[at].text == "(":
                if paren is None and at > start and (t[at - 1].kind == "name" or t[at - 1].text == ">"):
                    paren = at
                at = closing(t, at, end)
            elif t[at].text == "[":
                at = closing(t, at, end)
            at += 1
        stop, a, b = self.extent(at, end)
        line, last = t[min(first, end - 1)].line, t[min(stop - 1, end - 1)].line
        if paren is not None and t[start].text != "delegate":
            name_at = paren - 1
            if t[name_at].text == ">":
                depth = 0
                while name_at > start:
                    depth += (t[name_at].text == ">") - (t[name_at].text == "<")
                    name_at -= 1
                    if depth == 0:
                        break
            close = closing(t, paren, end)
            if name_at == start and t[start].text == self.types[-1]["simple"]:
                self.constructor(first, mods, public, paren, close, line, last, a, b)
            elif name_at > start and "operator" not in (x.text for x in t[start : name_at + 1]):
                self.method(attrs, mods, public, start, name_at, paren, close, line, last, a, b)
            else:
                self.body(a, b)
        elif at > start:
            self.field_or_property(public, start, at, line, a, b)
        return max(stop, first + 1)

    def extent(self, at: int, end: int) -> tuple[int, int, int]:
        """Index behind a member whose head ends at ``at``, and the range of its body."""
        t = self.t
        if at >= end or t[at].text in (";", "}"):
            return at + 1, at, at
        if t[at].text == "{":
            close = closing(t, at, end)
            if close + 1 < end and t[close + 1].text == "=":
                stop, _, _ = self.extent(close + 1, end)
                return stop, at + 1, stop
            return close + 1, at + 1, close
        k = at + 1
        while k < end and t[k].text != ";":
            if t[k].text in "([{":
                k = closing(t, k, end)
            k += 1
        return k + 1, at + 1, k

    def signature(self, a: int, b: int) -> str:
        text = " ".join(x.text for x in self.t[a:b] if x.kind != "doc")
        return re.sub(r" ?([.<>()\[\],?]) ?", r"\1", text).replace(",", ", ")

    def constructor(self, first, mods, public, paren, close, line, last, a, b) -> None:
        self.member = ".ctor"
        self.out["members"].append(
            {"type_name": self.owner, "member_name": ".ctor", "kind": "ctor", "signature": self.signature(mods, close + 1),
             "start_line": line, "end_line": last, "is_public": public}
        )
        for x, y, name, at in self.parameters(paren + 1, close):
            self.refs(x, y, "ctor-param", at)
            self.local(name, x, y)
        self.body(close + 1, b)
        self.member = None

    def method(self, attrs, mods, public, start, name_at, paren, close, line, last, a, b) -> None:
        name = self.t[name_at].text
        self.member = name
        self.out["members"].append(
            {"type_name": self.owner, "member_name": name, "kind": "method", "signature": self.signature(mods, close + 1),
             "start_line": line, "end_line": last, "is_public": public}
        )
        for attr, arg in attrs:
            bare = attr.removesuffix("Attribute")
            if bare in HTTP_ATTRIBUTES:
                parts = [p.strip("/") for p in (self.types[-1]["route"], arg) if p and p.strip("/")]
                route = "/" + "/".join(parts) if parts else (arg or name)
                self.out["endpoints"].append(
                    {"type_name": self.owner, "verb": bare[4:].upper(), "route": route, "method_name": name, "line": line}
                )
        if public:
            self.refs(start, name_at, "returns", line)
        for x, y, pname, at in self.parameters(paren + 1, close):
            if public:
                self.refs(x, y, "param", at)
            self.local(pname, x, y)
        self.returns(name, "method", start, name_at)
        self.body(a, b)
        self.member = None

    def returns(self, name: str, kind: str, a: int, b: int) -> None:
        names = self.type_names(a, b)
        if names:
            self.out["return_sigs"].append(
                {"type_name": self.owner, "member_name": name, "kind": kind, "return_simple_type": names[0], "ns": self.namespace}
            )

    def field_or_property(self, public, start, at, line, a, b) -> None:
        t = self.t
        if at - start < 2 or t[at - 1].kind != "name":
            self.body(a, b)
            return
        is_property = at < len(t) and t[at].text in ("{", "=>")
        heads = pieces(t, start, at)
        name_at = heads[0][1] - 1
        for x, y in [(start, name_at + 1), *heads[1:]]:
            self.local(t[y - 1].text, start, name_at)
        self.refs(start, name_at, "property" if is_property else "field", line)
        if is_property:
            self.returns(t[at - 1].text, "property", start, at - 1)
        if at < len(t) and t[at].text == "=" and a < b and t[a].text == "new" and t[a + 1].text == "(":
            names = self.type_names(start, name_at)
            if names:
                self.edge(names[0], "new", line)
        self.body(a, b)

    # ---- bodies

    def body(self, a: int, b: int) -> None:
        """Scan a body in source order."""
        t = self.t
        k = a
        while k < b:
            tok = t[k]
            if tok.kind == "name":
                begins = k == a or t[k - 1].text in (";", "{", "}", ")", "=>", "(") or t[k - 1].text in ("using", "await", "foreach", "for", "const", "else", "ref", "readonly")
                if begins:
                    self.local_declaration(k, b)
                if tok.text == "new":
                    self.creation(k, b)
                elif k + 1 < b and tok.text not in _NO_LOCAL:
                    opening = k + 1
                    if t[opening].text == "<" and (c := closing_angle(t, opening, b)) is not None:
                        opening = c + 1
                    if opening < b and t[opening].text == "(" and (k == a or t[k - 1].text != "new"):
                        done = self.invocation(a, k, opening, b)
                        if done is not None:
                            k = done
                            continue
            k += 1

    def local_declaration(self, k: int, b: int) -> None:
        t = self.t
        if t[k].text == "var":
            if k + 2 < b and t[k + 1].kind == "name" and t[k + 2].text == "=":
                self.inferred_local(t[k + 1].text, k + 3, b)
            return
        if t[k].text in _NO_LOCAL or t[k].kind != "name":
            return
        _, j = self.dotted(k, b)
        if j < b and t[j].text == "<":
            c = closing_angle(t, j, b)
            if c is None:
                return
            j = c + 1
        while j < b and t[j].text in ("?", "[", "]"):
            j += 1
        if j + 1 < b and t[j].kind == "name" and t[j].text not in _NO_LOCAL and t[j + 1].text in ("=", ";", ",", "in"):
            names = self.type_names(k, j)
            if self.locals is not None and names:
                self.locals[t[j].text] = names[0]
                if t[j + 1].text == "=" and j + 3 < b and t[j + 2].text == "new" and t[j + 3].text == "(":
                    self.edge(names[0], "new", t[j].line)

    def inferred_local(self, name: str, k: int, b: int) -> None:
        t = self.t
        stop = k
        while stop < b and t[stop].text != ";":
            if t[stop].text in "([{":
                stop = closing(t, stop, b)
            stop += 1
        stop = min(stop, b)
        while k < stop and t[k].text == "await":
            k += 1
        kind: list[str] = []
        if k < stop and t[k].text == "new":
            e = k + 1
            while e < stop and t[e].text not in ("(", "{", "["):
                e += 1
            kind = self.type_names(k + 1, e)
        elif k < stop and t[k].text == "(" and (c := closing(t, k, stop)) + 1 < stop and t[c + 1].kind in ("name", "string"):
            kind = self.type_names(k + 1, c)
        elif stop - 1 > k and t[stop - 1].text == ")":
            op = t.match[stop - 1]
            if op > k and t[op - 1].text == ">":
                low = op - 1
                while low > k and (t[low - 1].kind == "name" or t[low - 1].text in ("<", ">", ",", ".", "?", "[", "]", "::", "(", ")", "*")):
                    low -= 1
                lt = next((x for x in range(op - 1, low - 1, -1) if t[x].text == "<" and closing_angle(t, x, op) == op - 1), None)
                if lt is not None and lt > k and t[lt - 1].text not in NO_ELEMENT_TYPE:
                    kind = self.type_names(lt + 1, op - 1)
        if kind and self.locals is not None:
            self.locals[name] = kind[0]
            return
        steps = self.receiver(k, stop)
        if steps and self.owner:
            self.out["pending_locals"].append(
                {"declaring_type": self.owner, "declaring_member": self.member or "(none)", "local_name": name, "initializer": steps, "ns": self.namespace}
            )
            if self.locals is not None:
                self.locals[name] = None  # known to exist, its type is left to the index

    def creation(self, k: int, b: int) -> None:
        """``new T``; the implicit form takes the type of the assigned local."""
        t = self.t
        e = k + 1
        while e < b and t[e].text not in ("(", "{", "[", ";", ")", ","):
            if t[e].text == "<" and (c := closing_angle(t, e, b)) is not None:
                e = c
            e += 1
        if e > k + 1:
            self.refs(k + 1, e, "new", t[k].line)
        elif k >= 2 and t[k - 1].text == "=" and t[k - 2].kind == "name" and self.locals:
            declared = k >= 3 and (t[k - 3].kind == "name" or t[k - 3].text in (">", "?", "]"))
            known = self.locals.get(t[k - 2].text)
            if known and not declared:
                self.edge(known, "new", t[k].line)

    def chain_start(self, low: int, k: int) -> int:
        """Index where the receiver before the name at k begins (k itself: none)."""
        t = self.t
        j = k
        while j - 1 >= low and t[j - 1].text in (".", "?.", "::"):
            j -= 1
            if j - 1 >= low and t[j - 1].text == "!":
                j -= 1
            if j - 1 < low:
                break
            if t[j - 1].text in (")", "]"):
                j = max(t.match[j - 1], low)
                if j - 1 >= low and t[j - 1].text == ">":
                    depth, x = 0, j - 1
                    while x >= low:
                        depth += (t[x].text == ">") - (t[x].text == "<")
                        if depth == 0:
                            break
                        x -= 1
                    j = x
                if j - 1 >= low and t[j - 1].kind == "name" and t[j - 1].text not in ("await", "return", "if", "while", "in"):
                    j -= 1
                else:
                    break
            elif t[j - 1].kind in ("name", "string"):
                j -= 1
            else:
                break
            if (low, j) in self.chains:  # an earlier link of the same chain
                j = self.chains[low, j]
                break
        self.chains[low, k] = j
        return j

    def receiver(self, a: int, b: int) -> list[dict[str, Any]] | None:
        """Steps of an expression of names, calls and members; None for any other shape."""
        t = self.t
        while a < b and t[a].text == "await":
            a += 1
        if a < b and t[a].text == "(" and closing(t, a, b) == b - 1:
            return self.receiver(a + 1, b - 1)
        if a < b and t[a].text == "(":
            c = closing(t, a, b)
            head = self.receiver(a + 1, c)
            return self.members_after(head, c + 1, b) if head else None
        if a + 1 < b and t[a].text == "this" and t[a + 1].text == ".":
            a += 2
        if a >= b or t[a].kind != "name" or (a + 1 < b and t[a + 1].text in ("(", "<")):
            return None
        name = t[a].text
        known = (self.locals or {}).get(name)
        at, steps = self.walked.get(a, (b, None))
        if at < b and steps[0]["type_simple_name"] == known:  # an earlier link of the same chain goes so far
            steps = self.members_after(list(steps), at, b)
        else:
            steps = self.members_after([{"kind": "Local", "name": name, "ns": self.namespace, "type_simple_name": known}], a + 1, b)
        if steps:
            self.walked[a] = (b, steps)
        return steps

    def members_after(self, steps: list[dict[str, Any]], k: int, b: int) -> list[dict[str, Any]] | None:
        t = self.t
        while k < b:
            if t[k].text in ("!",):
                k += 1
                continue
            if t[k].text not in (".", "?.") or k + 1 >= b or t[k + 1].kind != "name":
                return None
            name = t[k + 1].text
            k += 2
            if k < b and t[k].text == "<" and (c := closing_angle(t, k, b)) is not None:
                k = c + 1
            kind = "PropertyAccess"
            if k < b and t[k].text == "(":
                kind, k = "MethodReturn", closing(t, k, b) + 1
            steps.append({"kind": kind, "name": name, "ns": None, "type_simple_name": None})
        return steps

    def invocation(self, low: int, k: int, opening: int, b: int) -> int | None:
        """A call of the name at k; returns where to go on if its arguments were read."""
        t = self.t
        method, line = t[k].text, t[k].line
        close = closing(t, opening, b)
        args = pieces(t, opening + 1, close)
        self.registration(method, k, opening, args, line)
        begin = self.chain_start(low, k)
        has_receiver = begin < k
        dot = k - 1 if has_receiver else k
        if has_receiver and method in MAP_METHODS and args and t[args[0][0]].kind == "string":
            self.minimal_api(method, args, line)
            return close
        steps = self.receiver(begin, dot) if has_receiver else None
        known = steps[0]["type_simple_name"] if steps and len(steps) == 1 else None
        if method in SEND_METHODS and has_receiver:
            self.send(steps, args, line)
        if steps:
            if len(steps) == 1 and known:
                self.out["call_sites"].append(
                    {"caller_type": self.owner or "<top-level>", "caller_member": self.member or "(top-level)", "callee_type": known,
                     "callee_member": method, "ns": self.namespace, "line": line}
                )
                self.edge(known, "call", line, member=method)
            elif self.owner and (steps[0]["type_simple_name"] or steps[0]["name"] in (self.locals or {})):  # no other root can be resolved
                self.out["pending_calls"].append(
                    {"caller_type": self.owner, "caller_member": self.member or "(none)", "callee_member": method, "receiver": steps,
                     "ns": self.namespace, "line": line}
                )
        return None

    def send(self, steps, args, line: int) -> None:
        known = steps[0]["type_simple_name"] if steps and len(steps) == 1 else None
        if known and not any(h in known for h in BUS_HINTS):
            return
        if not args:
            return
        a, b = args[0]
        t = self.t
        if t[a].text == "new":
            e = a + 1
            while e < b and t[e].text not in ("(", "{"):
                e += 1
            names = self.type_names(a + 1, e)
        else:
            names = [n] if b - a == 1 and t[a].kind == "name" and (n := (self.locals or {}).get(t[a].text)) else []
        if names:
            src = self.owner or "<top-level>"
            self.edge(names[0], "sends", line, src=src)

    def registration(self, method: str, k: int, opening: int, args, line: int) -> None:
        m = _REGISTER.match(method)
        if not m:
            return
        t = self.t
        if opening > k + 1:
            parts = pieces(t, k + 2, opening - 1)
        else:
            parts = [(a + 2, b - 1) for a, b in args if t[a].text == "typeof" and t[a + 1].text == "("]
        names = [self.type_names(a, b)[:1] for a, b in parts[:2]]
        if len(names) == 2 and all(names) and names[0] != names[1]:
            service, impl = names[0][0], names[1][0]
            self.out["di_bindings"].append(
                {"service_type": service, "implementation_type": impl, "lifetime": LIFETIMES[m.group(1)], "ns": self.namespace, "line": line}
            )
            self.out["edges"].append(
                {"from_type": service, "from_resolved": False, "to_type": impl, "to_resolved": False, "ns": self.namespace,
                 "relation": "di-bound", "line": line, "from_member": None}
            )

    def minimal_api(self, method: str, args, line: int) -> None:
        t = self.t
        verb, route = MAP_METHODS[method], _plain(t[args[0][0]].text)
        name = f"{verb} {route}"
        self.out["endpoints"].append({"type_name": name, "verb": verb, "route": route, "method_name": "(minimal-api)", "line": line})
        self.types.append({"name": name, "simple": name, "public": True, "route": None, "locals": {}})
        before, self.member = self.member, "(handler)"
        for n, (a, b) in enumerate(args[1:]):
            if n == 0 and b - a == 3 and t[a].kind == "name" and t[a + 1].text == "." and t[a].text not in NOISE_TYPES:
                self.edge(t[a].text, "call", line)
            start = a + (t[a].text == "async")
            if start < b and t[start].text == "(":
                for x, y, pname, _ in self.parameters(start + 1, closing(t, start, b)):
                    self.local(pname, x, y)
            self.body(a, b)
        self.member = before
        self.types.pop()


def _plain(literal: str) -> str:
    return literal.lstrip("$@").strip('"')


def _summary(docs: list[str]) -> str | None:
    text = " ".join(d[3:].strip() for d in docs)
    m = re.search(r"<summary>(.*?)</summary>", text, re.S)
    if not m:
        return None
    return " ".join(re.sub(r"<[^>]*>", "", m.group(1)).split()) or None


def extract(path: str, code: str | None) -> dict[str, Any] | None:
    """The fragment of one file without its hash; None for a text that cannot be read. ``failed``
    tells that reading broke off."""
    if code is None:
        return None
    reader = _Reader(path, Tokens())
    try:
        reader.t = tokenize(code)
        reader.read()
    except (IndexError, RecursionError):  # what was read so far, marked
        reader.out["failed"] = True
    return reader.out
