"""Serving queries over the result tables, and their JSON over HTTP."""

from __future__ import annotations

from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import today
from ..streaming.sinks import as_json


def day(date: int | str) -> str:
    """yyyyMMdd as the partition value yyyy-MM-dd."""
    d = str(date)
    return f"{d[:4]}-{d[4:6]}-{d[6:]}"


def gmv(orders: DataFrame, date: int | str) -> DataFrame:
    return orders.where(F.col("cur_date") == day(date)).agg(F.sum("order_amount").alias("order_amount"))


def province_amount(orders: DataFrame, date: int | str) -> DataFrame:
    return orders.where(F.col("cur_date") == day(date)).groupBy("province_name").agg(F.sum("order_amount").alias("order_amount"))


def channel_visitors(views: DataFrame, date: int | str, limit: int = 10) -> DataFrame:
    """Top channels by visitors, ties by name."""
    return views.where(F.col("cur_date") == day(date)).groupBy("ch").agg(F.sum("uv_ct").alias("uv_ct")).orderBy(F.desc("uv_ct"), "ch").limit(limit)


def gmv_json(orders: DataFrame, date: int | str | None = None) -> str:
    return as_json(status=0, data=gmv(orders, date or today()).first()[0])


def province_json(orders: DataFrame, date: int | str | None = None) -> str:
    rows = province_amount(orders, date or today()).orderBy("province_name").collect()
    return as_json(status=0, msg="", data={"mapData": [{"name": r[0], "value": r[1]} for r in rows], "valueName": "order amount"})


def channel_json(views: DataFrame, date: int | str | None = None, limit: int = 10) -> str:
    rows = channel_visitors(views, date or today(), limit).collect()
    return as_json(status=0, data={"categories": [r[0] for r in rows], "service": [{"name": "visitors", "data": [r[1] for r in rows]}]})


def server(orders: Callable[[], DataFrame], views: Callable[[], DataFrame], port: int = 0) -> ThreadingHTTPServer:
    """GET /gmv, /province and /ch with date=yyyyMMdd (and limit); start it with serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            date = args.get("date")
            if url.path == "/gmv":
                body = gmv_json(orders(), date)
            elif url.path == "/province":
                body = province_json(orders(), date)
            elif url.path == "/ch":
                body = channel_json(views(), date, int(args.get("limit", 10)))
            else:
                self.send_error(404)
                return
            data = body.encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json;charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
