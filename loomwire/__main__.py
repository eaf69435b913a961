"""python -m loomwire CONFIG [--schedule]: one run of the news pipeline, or runs on the configured schedule."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime, timezone
from typing import Any

from loomwire import clients, config, dims, schedule
from loomwire.plans.news import run_registry
from loomwire.session import session
from loomwire.sinks import DeliveryLog
from loomwire.sources.store import JdbcStore, ParquetStore


def services_of(spark, options: dict[str, Any], store: str | None) -> dict[str, Any]:
    if store:
        items = ParquetStore(spark, store)
    else:
        url = f"jdbc:postgresql://{options['database_host']}:{options['database_port']}/{options['database_name']}"
        items = JdbcStore(spark, url, user=options["database_user"], password=options["database_password"])
    sink = clients.BotSink(options["telegram_token"], parse_mode=options["send_parse_mode"])
    return {"store": items, "ai": clients.ai_client(options), "sink": DeliveryLog(sink), "errors": clients.ErrorChannels(clients.BotSink(options["telegram_token"], parse_mode=None), options["error_channels"])}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomwire", description=__doc__)
    parser.add_argument("config", help="dotenv file")
    parser.add_argument("--registry", help="Parquet table of the sources (see loomwire.operators.fetch); the known ones if not given")
    parser.add_argument("--store", help="folder of a Parquet store; without it the configured database")
    parser.add_argument("--schedule", action="store_true", help="run at the times of cron_expr")
    args = parser.parse_args(arguments)
    options = config.load_config(args.config)
    logging.basicConfig(level=logging.DEBUG if options["debug"] else logging.WARNING)
    if args.schedule and not options["cron_expr"]:
        parser.error("cron_expr is not set")
    spark = session("loomwire")
    restore = schedule.on_signals(spark.stop)

    def once() -> bool:
        services = services_of(spark, options, args.store)
        registry = spark.read.parquet(args.registry) if args.registry else spark.createDataFrame(dims.REGISTRY, dims.REGISTRY_COLUMNS)
        return run_registry(registry, services, {**options, "as_of": datetime.now(timezone.utc)}, services["errors"])

    try:
        if args.schedule:
            schedule.run_scheduled(once, schedule.Cron(options["cron_expr"], options["time_zone"]))
            return 0
        return 0 if once() else 1
    finally:
        restore()
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
