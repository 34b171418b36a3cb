"""Command line over a folder of tables: python -m postwarden ROOT COMMAND ...

ingest EML_FOLDER | analyze | profile | report [--tier T] | verdict ID | show ID | contacts |
stats | evaluate [--json] | view OUT.html | inspect FILE.eml [--detect]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import contacts as G
from .operators import profiles as P
from .operators.sync import first_seen
from .plans import engine, reports
from .sources.mailbox import eml_files
from .sources.tables import Tables


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="postwarden", description=__doc__)
    a.add_argument("root")
    a.add_argument("command", choices="ingest analyze profile report verdict show contacts stats evaluate view inspect profiles usage".split())
    a.add_argument("what", nargs="?")
    a.add_argument("--account", default="user@example.net")
    a.add_argument("--tier")
    a.add_argument("-n", type=int, default=25)
    a.add_argument("--limit", type=int)
    a.add_argument("--redo", action="store_true")
    a.add_argument("--detect", action="store_true")
    a.add_argument("--json", action="store_true")
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("postwarden").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables, accounts = Tables(spark, o.root), spark.createDataFrame([(1, o.account)], "account_id long, email string")
    have = lambda name: tables.read(name) if tables.versions(name) else None
    if o.command == "ingest":
        mail, old = engine.messages(eml_files(spark, o.what)), have("messages")
        fresh = mail if old is None else first_seen(old, mail)
        fresh = fresh.dropDuplicates(["account_id", "gmail_id"])
        # messages first: contacts of version n are folded from what message versions up to n brought, so a run that died between is caught up
        tables.write("messages", fresh if old is None else old.unionByName(fresh))
        tables.write("contacts", G.contacts(G.touches(tables.read("messages"))), batch=tables.last_batch("messages"))
    elif o.command == "analyze":
        old = have("verdicts")
        new = engine.analyze(tables.read("messages"), tables.read("contacts"), accounts, have("profiles"), have("intel"), have("answers"), old, o.redo, o.limit)
        tables.write("verdicts", new if old is None or o.redo else old.join(new, "message_id", "left_anti").unionByName(new))
    elif o.command == "profile":
        tables.write("profiles", P.build(engine.views(tables.read("messages")), have("verdicts")))
    elif o.command == "view":
        with open(o.what, "w", encoding="utf-8") as f:
            f.write(reports.as_page(tables.read("verdicts"), o.n))
    elif o.command == "evaluate":
        found = reports.evaluate(tables.read("messages"), tables.read("contacts"), accounts, have("profiles"), have("verdicts"))
        print(reports.as_json(found) if o.json else "\n\n".join(f"{k}\n{reports.as_text(v)}" for k, v in found.items()))
    else:
        shown = {
            "report": lambda: reports.flagged(tables.read("verdicts"), o.tier, o.n).select("gmail_id", "score", "tier", "from_addr", "subject", "headline"),
            "verdict": lambda: reports.verdict(tables.read("verdicts"), o.what).select("code", "layer", "severity", "weight", "human_text"),
            "show": lambda: reports.show(tables.read("messages"), o.what),
            "contacts": lambda: G.top_contacts(tables.read("contacts"), o.n),
            "profiles": lambda: reports.profile_list(tables.read("profiles"), o.n),
            "usage": lambda: reports.usage(tables.read("answers")),
            "stats": lambda: reports.stats(tables.read("messages"), tables.read("contacts")),
            "inspect": lambda: reports.inspect(spark, o.what, o.detect),
        }[o.command]()
        print(reports.as_text(shown, o.n))


if __name__ == "__main__":
    main()
