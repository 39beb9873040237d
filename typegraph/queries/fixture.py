"""Queries over a few C# files that stand here, with the rows that must come out.

The test tables hold no registrations, aliases, handlers or directives, and what calls and
chains resolve to can't be said by lines, so these forms are checked on texts of our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.extract.scan import fragments
from typegraph.plans.index import build_graph

FILES = {
    "Harbor/Berth.cs": '''
using Harbor.Tides;
using Gauge = Harbor.Tides.TideGauge;

namespace Harbor.Docks
{
    /** <summary>Keeps ships
     *  and their lines.</summary> */
    public class BerthKeeper : KeeperBase<IMooring>, IRequestHandler<MoorShip, int>, IKeep<Ship>
    {
        private readonly IMooring _mooring;
        private readonly Gauge _gauge;
        private readonly ILog _log;

        public BerthKeeper(IMooring mooring, Gauge gauge, ILog log) { _mooring = mooring; _gauge = gauge; _log = log; }

        public int Handle(MoorShip order)
        {
            _log.Write($"moor {_mooring.Find(order.Name, $"x{_gauge.Read()}")} now {{_log.Never()}}");
            _log.Write($@"at ""{_gauge.Zero()}""");
            return _mooring.Line().Tension().Value();
        }

#if DEEP
        private readonly DeepOnly _deep;
#elif !DEEP
        private readonly ShallowOnly _shallow;
#else
        private readonly NeverRead _never;
#endif

        public void Chain()
        {
            var a = _mooring.Line();
            var b = a.Next();
            var c = b.Next();
            var d = c.Next();
            var e = d.Next();
            var f = e.Next();
            var g = f.Next();
            var h = g.Next();
            h.Slack();
        }
    }
}
''',
    "Harbor/Mooring.cs": """
namespace Harbor.Docks;

public interface IMooring { Rope Line(); Ship Find(string name, string mark); }
public class Rope { public Rope Next() => this; public Load Tension() => null; public void Slack() { } }
public record Load(decimal Weight) { public decimal Value() => Weight; }
public record MoorShip(string Name);
public class Ship { }
public class RopeMooring : IMooring
{
    public Rope Line() { return new Rope(); }
    public Ship Find(string name, string mark) { var s = new Ship(); return s; }
}
""",
    "Harbor/Tides.cs": """
namespace Harbor.Tides;

public class TideGauge { public Level Read() => new(); public int Zero() { return 0; } }
public struct Level { }
""",
    "Program.cs": """
using Harbor.Docks;

services.AddScoped<IMooring, RopeMooring>();
services.AddKeyedSingleton<IKeep<Ship>, BerthKeeper>("berth");
services.TryAddTransient(typeof(IMooring), typeof(RopeMooring));
services.AddScoped<Ship>();
app.MapPost("/ships/{name}", (IMooring moorings, string name) => moorings.Find(name, ""));
app.MapGet("/ropes", Rope.Next);
""",
    "Harbor/Desk.cs": """
namespace Harbor.Desk;

[Route("desk/[controller]")]
public class ArrivalController
{
    private readonly IMediator _mediator;
    [HttpPost("{name}/moor")]
    public async Task<int> Moor(string name) => await _mediator.Send(new MoorShip(name));
    [HttpGet]
    public Task<List<Ship>> Ships() => null;
}
""",
}


def _fragments(spark: SparkSession) -> DataFrame:
    return fragments(spark.createDataFrame(list(FILES.items()), "file_path string, code string"))


def fixture_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Types with a block as summary, nested in a namespace's braces, and in one line."""
    return _fragments(spark).select(F.explode("nodes").alias("x")).select("x.name", "x.kind", "x.start_line", "x.end_line", F.coalesce("x.summary", F.lit("")).alias("summary"))


def fixture_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes of attributes with a controller's prefix and of mapped lambdas."""
    return _fragments(spark).select(F.explode("endpoints").alias("x")).select("x.type_name", "x.verb", "x.route", "x.method_name", "x.line")


def fixture_di(spark: SparkSession, d: str) -> DataFrame:
    """Registrations by type arguments and by typeof, resolved."""
    return build_graph(_fragments(spark), spark).di.select("service", "impl", "lifetime", "line")


def fixture_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of files."""
    return _fragments(spark).select("file_path", F.explode("aliases").alias("alias", "target"))


def fixture_returns(spark: SparkSession, d: str) -> DataFrame:
    """Return types that chains can follow."""
    return _fragments(spark).select(F.explode("return_sigs").alias("x")).select("x.type_name", "x.member_name", "x.return_simple_type")


def fixture_edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved relations: base lists by name, messages, active branches, calls in holes."""
    e = build_graph(_fragments(spark), spark).edges
    return e.groupBy("src", "dst", "relation").agg(F.count("*").cast("int").alias("n"))


def fixture_calls(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls, those in interpolated strings, of chains and of locals of locals included."""
    return build_graph(_fragments(spark), spark).calls.select("caller", "member", "callee", "callee_member", "line")


QUERIES = {
    f.__name__: f
    for f in (fixture_nodes, fixture_endpoints, fixture_di, fixture_aliases, fixture_returns, fixture_edges, fixture_calls)
}


def _values(columns: str, rows: str) -> str:
    """SQL of fixed rows."""
    return f"SELECT * FROM (VALUES {rows}) t({columns})"


SQL = {
    "fixture_nodes": _values("name, kind, start_line, end_line, summary", """
('Harbor.Desk.ArrivalController', 'Class', 4, 12, ''),
('Harbor.Docks.BerthKeeper', 'Class', 9, 44, 'Keeps ships and their lines.'),
('Harbor.Docks.IMooring', 'Interface', 4, 4, ''),
('Harbor.Docks.Load', 'Record', 6, 6, ''),
('Harbor.Docks.MoorShip', 'Record', 7, 7, ''),
('Harbor.Docks.Rope', 'Class', 5, 5, ''),
('Harbor.Docks.RopeMooring', 'Class', 9, 13, ''),
('Harbor.Docks.Ship', 'Class', 8, 8, ''),
('Harbor.Tides.Level', 'Struct', 5, 5, ''),
('Harbor.Tides.TideGauge', 'Class', 4, 4, '')"""),
    "fixture_endpoints": _values("type_name, verb, route, method_name, line", """
('GET /ropes', 'GET', '/ropes', '(minimal-api)', 9),
('Harbor.Desk.ArrivalController', 'GET', '/desk/Arrival', 'Ships', 10),
('Harbor.Desk.ArrivalController', 'POST', '/desk/Arrival/{name}/moor', 'Moor', 8),
('POST /ships/{name}', 'POST', '/ships/{name}', '(minimal-api)', 8)"""),
    "fixture_di": _values("service, impl, lifetime, line", """
('HARBOR.DOCKS.IMOORING', 'HARBOR.DOCKS.ROPEMOORING', 'scoped', 4),
('HARBOR.DOCKS.IMOORING', 'HARBOR.DOCKS.ROPEMOORING', 'transient', 6),
('IKEEP', 'HARBOR.DOCKS.BERTHKEEPER', 'singleton', 5)"""),
    "fixture_aliases": _values("file_path, alias, target", """
('Harbor/Berth.cs', 'Gauge', 'Harbor.Tides.TideGauge')"""),
    "fixture_returns": _values("type_name, member_name, return_simple_type", """
('Harbor.Desk.ArrivalController', 'Ships', 'Ship'),
('Harbor.Docks.IMooring', 'Find', 'Ship'),
('Harbor.Docks.IMooring', 'Line', 'Rope'),
('Harbor.Docks.Rope', 'Next', 'Rope'),
('Harbor.Docks.Rope', 'Tension', 'Load'),
('Harbor.Docks.RopeMooring', 'Find', 'Ship'),
('Harbor.Docks.RopeMooring', 'Line', 'Rope'),
('Harbor.Tides.TideGauge', 'Read', 'Level')"""),
    "fixture_edges": _values("src, dst, relation, n", """
('GET /ROPES', 'HARBOR.DOCKS.ROPE', 'call', 1),
('HARBOR.DESK.ARRIVALCONTROLLER', 'HARBOR.DOCKS.MOORSHIP', 'new', 1),
('HARBOR.DESK.ARRIVALCONTROLLER', 'HARBOR.DOCKS.MOORSHIP', 'sends', 1),
('HARBOR.DESK.ARRIVALCONTROLLER', 'HARBOR.DOCKS.SHIP', 'returns', 1),
('HARBOR.DESK.ARRIVALCONTROLLER', 'IMEDIATOR', 'call', 1),
('HARBOR.DESK.ARRIVALCONTROLLER', 'IMEDIATOR', 'field', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.IMOORING', 'call', 3),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.IMOORING', 'ctor-param', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.IMOORING', 'field', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.IMOORING', 'implements', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.LOAD', 'call', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.MOORSHIP', 'inherits', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.MOORSHIP', 'param', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.ROPE', 'call', 9),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.DOCKS.SHIP', 'inherits', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.TIDES.TIDEGAUGE', 'call', 2),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.TIDES.TIDEGAUGE', 'ctor-param', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'HARBOR.TIDES.TIDEGAUGE', 'field', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'IKEEP', 'implements', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'ILOG', 'call', 2),
('HARBOR.DOCKS.BERTHKEEPER', 'ILOG', 'ctor-param', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'ILOG', 'field', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'IREQUESTHANDLER', 'implements', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'KEEPERBASE', 'inherits', 1),
('HARBOR.DOCKS.BERTHKEEPER', 'SHALLOWONLY', 'field', 1),
('HARBOR.DOCKS.IMOORING', 'HARBOR.DOCKS.ROPEMOORING', 'di-bound', 2),
('HARBOR.DOCKS.MOORSHIP', 'HARBOR.DOCKS.BERTHKEEPER', 'handled-by', 1),
('HARBOR.DOCKS.ROPE', 'HARBOR.DOCKS.LOAD', 'returns', 1),
('HARBOR.DOCKS.ROPEMOORING', 'HARBOR.DOCKS.IMOORING', 'implements', 1),
('HARBOR.DOCKS.ROPEMOORING', 'HARBOR.DOCKS.ROPE', 'new', 1),
('HARBOR.DOCKS.ROPEMOORING', 'HARBOR.DOCKS.ROPE', 'returns', 1),
('HARBOR.DOCKS.ROPEMOORING', 'HARBOR.DOCKS.SHIP', 'new', 1),
('HARBOR.DOCKS.ROPEMOORING', 'HARBOR.DOCKS.SHIP', 'returns', 1),
('HARBOR.TIDES.TIDEGAUGE', 'HARBOR.TIDES.LEVEL', 'returns', 1),
('IKEEP', 'HARBOR.DOCKS.BERTHKEEPER', 'di-bound', 1),
('POST /SHIPS/{NAME}', 'HARBOR.DOCKS.IMOORING', 'call', 1)"""),
    "fixture_calls": _values("caller, member, callee, callee_member, line", """
('HARBOR.DESK.ARRIVALCONTROLLER', 'Moor', 'IMEDIATOR', 'Send', 9),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.IMOORING', 'Line', 34),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 35),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 36),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 37),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 38),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 39),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 40),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Next', 41),
('HARBOR.DOCKS.BERTHKEEPER', 'Chain', 'HARBOR.DOCKS.ROPE', 'Slack', 42),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.DOCKS.IMOORING', 'Find', 19),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.DOCKS.IMOORING', 'Line', 21),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.DOCKS.LOAD', 'Value', 21),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.DOCKS.ROPE', 'Tension', 21),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.TIDES.TIDEGAUGE', 'Read', 19),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'HARBOR.TIDES.TIDEGAUGE', 'Zero', 20),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'ILOG', 'Write', 19),
('HARBOR.DOCKS.BERTHKEEPER', 'Handle', 'ILOG', 'Write', 20),
('POST /SHIPS/{NAME}', '(handler)', 'HARBOR.DOCKS.IMOORING', 'Find', 8)"""),
}
