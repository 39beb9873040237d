"""The extraction front-end on small texts, exact rows."""

import pytest

from typegraph.extract.csharp import extract
from typegraph.extract.lexer import tokenize


def edges(f):
    return {(e["from_type"], e["relation"], e["to_type"]) for e in f["edges"]}


def calls(f):
    return {(c["caller_type"], c["caller_member"], c["callee_type"], c["callee_member"]) for c in f["call_sites"]}


def test_message_flow():
    f = extract("a.cs", """
namespace Shop;
public class OpenCart { }
public class OpenCartHandler : IRequestHandler<OpenCart, int>
{
    private readonly ICartStore _store;
    public OpenCartHandler(ICartStore store) { _store = store; }
    public Task<int> Handle(OpenCart request, CancellationToken ct) { return _store.Create(request); }
}
public class CartController
{
    private readonly IMediator _mediator;
    public CartController(IMediator mediator) => _mediator = mediator;
    public async Task<int> Post() { return await _mediator.Send(new OpenCart()); }
}
""")
    e = edges(f)
    assert ("Shop.CartController", "sends", "OpenCart") in e
    assert ("OpenCart", "handled-by", "OpenCartHandler") in {(a, r, b.rsplit(".", 1)[-1]) for a, r, b in e}
    assert ("Shop.OpenCartHandler", "ctor-param", "ICartStore") in e
    assert ("Shop.OpenCartHandler", "Handle", "ICartStore", "Create") in calls(f)
    assert f["endpoints"] == []


def test_handler_edge_goes_from_message_to_handler():
    f = extract("a.cs", "class H : IRequestHandler<Cmd, int> { }")
    assert ("Cmd", "handled-by", "H") in edges(f)


def test_minimal_api():
    f = extract("Start.cs", 'web.MapDelete("/berths/{no:int}", async (int no, BerthBook book) => await book.Release(no));')
    assert [(e["type_name"], e["verb"], e["route"], e["method_name"]) for e in f["endpoints"]] == [
        ("DELETE /berths/{no:int}", "DELETE", "/berths/{no:int}", "(minimal-api)")
    ]
    assert ("DELETE /berths/{no:int}", "(handler)", "BerthBook", "Release") in calls(f)


def test_minimal_api_method_group():
    f = extract("Program.cs", 'app.MapPost("/x", Orders.Handle);')
    assert ("POST /x", "call", "Orders") in edges(f)


def test_controller_routes():
    f = extract("a.cs", """
[Authorize, Route("/harbor/[controller]/")]
public class TugController : Desk
{
    [HttpPut("{tug}/crew"), Logged] public void Crew(string tug) { }

    [Logged]
    [HttpPatch]
    public void Rename() { }
}
""")
    assert {(e["verb"], e["route"], e["line"]) for e in f["endpoints"]} == {("PUT", "/harbor/Tug/{tug}/crew", 5), ("PATCH", "/harbor/Tug", 7)}


def test_route_without_parts_is_the_method():
    f = extract("a.cs", "class C { [HttpGet] public int All() => 1; }")
    assert [e["route"] for e in f["endpoints"]] == ["All"]


def test_registrations():
    f = extract("a.cs", """
box.TryAddSingleton<ILighthouse, StoneLighthouse>();
box.AddScoped(typeof(IFoghorn<>), typeof(AirFoghorn<>));
box.AddKeyedTransient<IBuoy, RedBuoy>("north"); box.AddSingleton<RedBuoy>(); box.AddScoped<IBuoy, IBuoy>();
""")
    got = [(b["service_type"], b["implementation_type"], b["lifetime"], b["line"]) for b in f["di_bindings"]]
    assert got == [("ILighthouse", "StoneLighthouse", "singleton", 2), ("IFoghorn", "AirFoghorn", "scoped", 3), ("IBuoy", "RedBuoy", "transient", 4)]


def test_nested_types_and_file_scoped_namespace():
    f = extract("a.cs", "namespace A.B;\nclass Flow { public class Handler { } class Other { } }\nenum E { X }")
    assert [n["name"] for n in f["nodes"]] == ["A.B.Flow", "A.B.Flow.Handler", "A.B.Flow.Other"]


def test_block_namespaces_nest():
    f = extract("a.cs", "namespace A { namespace B { struct S { } } record R(Foo X); }")
    assert [(n["name"], n["kind"]) for n in f["nodes"]] == [("A.B.S", "Struct"), ("A.R", "Record")]
    assert ("A.R", "ctor-param", "Foo") in edges(f)


def test_containers_are_passed_through():
    f = extract("a.cs", "class Repo { public Task<List<Foo>> A() => null; public IEnumerable<Bar> B() => null; }")
    assert {e for e in edges(f) if e[1] == "returns"} == {("Repo", "returns", "Foo"), ("Repo", "returns", "Bar")}


@pytest.mark.parametrize("kind", ["SmtpClient", "Order", "Socket"])
def test_send_on_other_receivers(kind):
    f = extract("a.cs", f"class C {{ private readonly {kind} _x; public void M() {{ _x.Send(new Mail()); _x.Dispatch(new Mail()); }} }}")
    assert not [e for e in f["edges"] if e["relation"] == "sends"]


def test_send_on_unknown_receiver_counts():
    f = extract("a.cs", "class C { public void M() { bus.Publish(new Moved()); } }")
    assert ("C", "sends", "Moved") in edges(f)


def test_null_conditional():
    f = extract("a.cs", "class Caller { private readonly IService _svc; public void M() { _svc?.Run(); } }")
    assert ("Caller", "M", "IService", "Run") in calls(f)


def test_lambda_bodies():
    f = extract("a.cs", "class C { private readonly IService _svc; public void M() { Task.Run(() => _svc.Run()); } }")
    assert ("C", "M", "IService", "Run") in calls(f)


def test_chains_leave_steps():
    f = extract("a.cs", """
class Host {
    private readonly IFactory _factory;
    private readonly Outer _outer;
    public async Task M() { _factory.Get().Run(); _outer.Inner.Stop(); var s = await _factory.GetAsync(); s.Run(); }
}""")
    got = [([(s["kind"], s["name"], s["type_simple_name"]) for s in p["receiver"]], p["callee_member"]) for p in f["pending_calls"]]
    assert ([("Local", "_factory", "IFactory"), ("MethodReturn", "Get", None)], "Run") in got
    assert ([("Local", "_outer", "Outer"), ("PropertyAccess", "Inner", None)], "Stop") in got
    assert ([("Local", "s", None)], "Run") in got
    assert [(p["local_name"], len(p["initializer"])) for p in f["pending_locals"]] == [("s", 2)]


def test_inferred_locals():
    f = extract("a.cs", """
class C { public void M() {
    var a = new Foo(); a.A(); var b = (Bar)x; b.B(); var c = sp.GetRequiredService<Baz>(); c.D(); Qux d = Make(); d.E(); } }""")
    assert {(c[2], c[3]) for c in calls(f)} >= {("Foo", "A"), ("Bar", "B"), ("Baz", "D"), ("Qux", "E")}


def test_creation_and_implicit_creation():
    f = extract("a.cs", "class C { private Foo _f = new(); public void M() { var x = new Bar<Baz>(1); Qux q = new(); _f = new(); } }")
    assert {e[2] for e in edges(f) if e[1] == "new"} == {"Foo", "Bar", "Baz", "Qux"}


def test_base_list_rule():
    f = extract("a.cs", "class C : Base, IThing, Other<Arg> where T : class { }")
    assert {e for e in edges(f)} == {("C", "inherits", "Base"), ("C", "implements", "IThing"), ("C", "inherits", "Other"), ("C", "inherits", "Arg")}


def test_members_spans_and_visibility():
    f = extract("a.cs", "public class C\n{\n    public C(int x) { }\n\n    /// <summary>Adds\n    /// up.</summary>\n    private int Add(int a,\n        int b)\n    {\n        return a + b;\n    }\n}\n")
    got = [(m["member_name"], m["kind"], m["start_line"], m["end_line"], m["is_public"]) for m in f["members"]]
    assert got == [(".ctor", "ctor", 3, 3, True), ("Add", "method", 7, 11, False)]


def test_usings_aliases_summary():
    f = extract("a.cs", "using System;\nusing A.B;\nusing X = Foo.Bar;\n/// <summary>\n/// One line.\n/// </summary>\npublic interface IThing { }")
    assert f["usings"] == ["System", "A.B"] and f["aliases"] == {"X": "Foo.Bar"}
    assert f["nodes"][0]["summary"] == "One line." and f["nodes"][0]["start_line"] == 7


def test_strings_and_comments_hide_code():
    f = extract("a.cs", 'class C { string s = "class D { }"; /* class E { } */ string r = @"a ""new X()"" b"; char c = \'{\'; }')
    assert [n["name"] for n in f["nodes"]] == ["C"]
    assert not [e for e in f["edges"] if e["relation"] == "new"]


@pytest.mark.parametrize("code", ["", "   ", "}}}}", "class", "class C {", "((((", "namespace ;", "﻿using A;", "a" * 100_000, 'class C { string s = "'])
def test_broken_texts(code):
    extract("a.cs", code)
    assert extract("a.cs", None) is None


def kept(code):
    return " ".join(t.text for t in tokenize(code))


def test_branches_of_directives():
    assert kept("#if A\nx\n#elif !A && (B || true)\ny\n#if C\nc\n#else\nd\n#endif\n#else\nz\n#endif\nend") == "y d end"
    assert kept("#define A\n#if A == true\nx\n#undef A\n#else\ny\n#endif\n#if A\nz\n#endif") == "x"
    assert kept("#if A\nx\n  # if B\n#endif\ny") == "" and kept("#endif\nx\n#else\ny") == "x y" and kept("#if (\nx\n#endif\ny") == "y"
    assert kept('var s = """\n#if A\nx\n#endif\n""";').count("x") == 1


def test_holes_of_strings():
    inner = lambda code: [t.text for t in tokenize(code) if t.kind == "name"]
    assert inner('$"a {b} {{c}} {d:N2} {e, 5}"') == ["b", "d", "N2", "e"]
    assert inner('$"{F("x}", \'}\')}" + g') == ["F", "g"]
    assert inner('$@"C:\\{a}\\""q"" {b}" c') == ["a", "b", "c"] == inner('@$"C:\\{a}\\""q"" {b}" c')
    assert inner('$$"""{x} {{a}} " {{{b}}} """ c') == ["a", "b", "c"] and inner('$"""{a}\n"{b}""" c') == ["a", "b", "c"]
    assert inner('$"{ $"{a}" } {new[] { b }.Length}') == ["a", "new", "b", "Length"]
    assert [t.line for t in tokenize('$@"\n\n{a}\n{b}" c') if t.kind == "name"] == [3, 4, 4]
    for odd in ('$"', '$"{', '$"{a', '$@"{"', '$"""{', "$", "$$$", '$"\n{a}'):
        tokenize(odd)


def test_calls_in_strings():
    f = extract("a.cs", 'class C { private readonly IBell _bell; void M() { var s = $"rung {_bell.Count("today")} times"; Log($"x{_bell.Name}"); } }')
    assert calls(f) == {("C", "M", "IBell", "Count")}


def test_block_summary():
    f = extract("a.cs", "/** <summary>Rings\n  * twice.</summary>\n */\nclass C { }\n/***/ class D { }")
    assert [n["summary"] for n in f["nodes"]] == ["Rings twice.", None]


def test_base_names_are_judged_alone():
    f = extract("a.cs", "class C : IStore<Order>, Base<IClock> { }")
    assert edges(f) == {("C", "implements", "IStore"), ("C", "inherits", "Order"), ("C", "inherits", "Base"), ("C", "implements", "IClock")}


def test_time_follows_the_length():
    import time

    deep = "class C { void M() { " + "F(x => { var y = " * 1000 + "1" + "; })" * 1000 + " } }"
    for code in ("class C { Reel _r; void M() { var q = _r" + ".Add(1)" * 1000 + "; } }", deep, "class C { void M() { var q = r" + "!.Add<int>(1)[0]" * 1000 + "; } }"):
        began = time.process_time()
        assert not extract("a.cs", code)["failed"]
        assert time.process_time() - began < 2


def test_lines_count_from_one_for_any_line_end():
    assert [t.line for t in tokenize("a\r\nb\rc\nd")] == [1, 2, 3, 4]
