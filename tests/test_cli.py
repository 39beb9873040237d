"""The command line over a small folder."""

import pytest

from typegraph import cli

CODE = """
namespace App;
/// <summary>Settles what the ledger owes.</summary>
public class Ledger { private readonly IStore _store; public void Settle() { _store.Put(); } }
[Route("api")] public class LedgerController { private readonly Ledger _ledger; [HttpPost("settle")] public void Post() { _ledger.Settle(); } }
public interface IStore { void Put(); }
public class FileStore : IStore { public void Put() { } }
"""


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.cs").write_text(CODE)
    store, root = str(tmp_path / "store"), str(tmp_path / "src")
    cli.main([store, "scan", root])
    assert "nodes" in capsys.readouterr().out
    for args, want in [
        (["trace", "IStore", "-d", "4"], "APP.LEDGERCONTROLLER"), (["source", "Ledger", "Settle", "-r", root], "_store.Put"),
        (["semantic", "settle a ledger"], "APP.LEDGER"),
    ]:
        cli.main([store, *args])
        assert want in capsys.readouterr().out, args
    with pytest.raises(SystemExit):
        cli.main([store, "callers", "Nothing"])
