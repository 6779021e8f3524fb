"""The paged search of the document service as a batch and a streaming source.

In batch, filters on what the service can search by go into the request, the first page of each
request tells its total, and page ranges are planned from it. As a stream, offsets are each
type's cursor, the newest delivery it has seen; a micro-batch asks for what was delivered since
the cursor less the overlap, and keyed upserts absorb what comes again.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lastro.session import importable
from lastro.sources.csvzip import _file

PAGE, MOST_PAGES, RETRIES = 100, 2000, 4
#: Pages of a request that lie together where answers are stored as lines.
SPAN = 128
#: Seconds between two requests at least (fixed value).
INTERVAL = 1.0
#: A sync begins this long before its cursor; the keyed upsert absorbs what comes again (fixed value).
OVERLAP = dt.timedelta(days=1)
#: Forms of a delivery's time, in this order (fixed values).
DELIVERED = ("%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y")


class ShapeError(ValueError):
    """An answer lacks what it must have."""


def fetch_with_retry(fetch: Callable[[], bytes], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> bytes:
    """Tries again after 2, 4, 8... seconds. An error with a status from 400 to 499 fails at once."""
    for k in range(retries):
        try:
            return fetch()
        except Exception as exc:
            status = getattr(exc, "status", None) or getattr(exc, "code", None)
            if (isinstance(status, int) and 400 <= status < 500) or k == retries - 1:
                raise
            wait(2.0 ** (k + 1))
    raise AssertionError


def spaced(fetch: Callable[[str], bytes], interval: float = INTERVAL, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[str], bytes]:
    """fetch, called no sooner than `interval` seconds after it was last called."""
    last = [float("-inf")]

    def run(url: str) -> bytes:
        left = last[0] + interval - clock()
        if left > 0:
            wait(left)
        last[0] = clock()
        return fetch(url)

    return run


def check_shape(answer: dict) -> list[dict]:
    """The records of an answer, which must be an object with a list of objects under `data`."""
    if not isinstance(answer, dict) or "data" not in answer:
        raise ShapeError(f"the answer has no data; it has {list(answer)[:10] if isinstance(answer, dict) else type(answer).__name__}")
    rows = answer["data"] or []
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ShapeError("the answer's data is no list of records")
    return rows


def total_of(answer: dict) -> int:
    """How many records a request has in all; those of a first page if the service doesn't say."""
    said = answer.get("recordsFiltered") or answer.get("recordsTotal")
    return int(said) if said else len(check_shape(answer))


@dataclass(frozen=True)
class Search:
    """What a request asks for; None asks for nothing."""

    tipo: str
    cnpj: str | None = None
    id_categoria: int | None = None
    id_tipo: int | None = None
    id_especie: int | None = None
    desde: str | None = None  # days as dd/mm/yyyy, both included
    ate: str | None = None
    ordem: str = "asc"

    def params(self, start: int, length: int) -> dict[str, str | int]:
        """The request's parameters, by the names that the service gives them (fixed values)."""
        asked = {
            "d": 1, "s": start, "l": length, "o[0][dataEntrega]": self.ordem, "tipoFundo": self.tipo, "idCategoriaDocumento": self.id_categoria or 0, "idTipoDocumento": self.id_tipo or 0,
            "idEspecieDocumento": self.id_especie or 0, "paginaCertificados": "false",
        }
        return asked | {k: v for k, v in (("cnpjFundo", self.cnpj), ("dataInicial", self.desde), ("dataFinal", self.ate)) if v}

    def name(self) -> str:
        """The request's name among stored answers: its type, and what it asks for besides."""
        rest = [("cnpj", self.cnpj), ("categoria", self.id_categoria), ("tipo", self.id_tipo), ("especie", self.id_especie), ("desde", _iso(self.desde)), ("ate", _iso(self.ate)), ("ordem", None if self.ordem == "asc" else self.ordem)]
        return "~".join([self.tipo, *[f"{k}_{v}" for k, v in rest if v]])


def _iso(day: str | None) -> str | None:
    return f"{day[6:]}-{day[3:5]}-{day[:2]}" if day else None


def day_text(moment: dt.datetime | dt.date) -> str:
    return moment.strftime("%d/%m/%Y")


def delivered(record: dict) -> dt.datetime | None:
    text = str(record.get("dataEntrega") or "").strip()
    for form in DELIVERED:
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            pass
    return None


Answer = Callable[[Search, int, int], dict]


def service(url: str, interval: float) -> Answer:
    """Answers of the service itself."""

    def get(address: str) -> bytes:
        asked = Request(address, headers={"Accept": "application/json", "X-Requested-With": "XMLHttpRequest"})
        with urlopen(asked, timeout=60) as answer:  # noqa: S310  the caller names the service
            return answer.read()

    fetch = spaced(get, interval)

    def ask(search: Search, start: int, length: int) -> dict:
        content = fetch_with_retry(partial(fetch, f"{url}?{urlencode(search.params(start, length))}"))
        try:
            return json.loads(content)
        except ValueError as exc:
            raise ShapeError(f"the answer is no JSON; it begins with {content[:120]!r}") from exc

    return ask


def stored(folder: str) -> Answer:
    """Answers that were kept: <request>-<page>.json, files in a folder request=<request>-<page>, or
    lines of the page's number, a blank and the answer in request=<request>/pages=<n>, n the number over SPAN.

    Past a request's last page there is none. A request that asks for more than a type and has
    no first page of its own is an error: an answer to less would have other rows.
    """
    files, root = _file(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    #: The lines that were read last: pages are asked for in turn.
    held: dict[tuple[str, int], dict[int, bytes]] = {}

    def inside(name: str) -> list[bytes]:
        found = files.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True))
        content = []
        for path in sorted(i.path for i in found if i.is_file and i.base_name[0] not in "._"):
            with files.open_input_stream(path) as stream:
                content.append(stream.read())
        return content

    def ask(search: Search, start: int, length: int) -> dict:
        page = start // length
        here = (search.name(), page // SPAN)
        if here not in held:
            held.clear()
            lines = (line.partition(b" ") for part in inside(f"request={here[0]}/pages={here[1]}") for line in part.split(b"\n") if line)
            held[here] = {int(k): v for k, _, v in lines}
        content = held[here].get(page)
        if content is None:
            alone = f"{search.name()}-{page}"
            if files.get_file_info(f"{root}/{alone}.json").type == fs.FileType.File:
                with files.open_input_stream(f"{root}/{alone}.json") as stream:
                    content = stream.read()
            else:
                parts = inside(f"request={alone}")
                content = b"".join(parts) if parts else None
        if content is None:
            if page == 0 and search != Search(search.tipo):
                raise FileNotFoundError(f"no stored answer to {search.name()}")
            return {"data": [], "recordsFiltered": start}
        return json.loads(content)

    return ask


def answers(options: dict, interval: float = 0.0) -> Answer:
    return service(options["url"], interval) if "url" in options else stored(options["files"])


@dataclass
class Pages(InputPartition):
    """Pages [first, last) of a request, and the times that rows lie between."""

    search: Search
    first: int
    last: int
    interval: float
    since: str | None = None
    until: str | None = None


COLUMNS = "tipo string, cnpj string, id_categoria int, id_tipo int, id_especie int, entrega timestamp_ntz, arrival long, value string"


class Planner:
    """Plans and reads pages. Options: tipos (comma-separated), url or files, size, maxPages, tasks, interval."""

    def __init__(self, options: dict):
        self.options = options
        self.size = int(options.get("size", PAGE))
        self.most = int(options["maxpages"]) if "maxpages" in options else None
        # The service allows a request a second, so it is one task's; stored answers are not limited.
        self.tasks = int(options.get("tasks", 1 if "url" in options else 8))
        self.interval = float(options.get("interval", INTERVAL if "url" in options else 0.0)) * self.tasks

    def plan(self, search: Search, ask: Answer, **bounds: str | None) -> list[Pages]:
        """Page ranges of a request from the total that its first page states, as many as tasks at most."""
        first = ask(search, 0, self.size)
        rows, total = check_shape(first), total_of(first)
        # Where the service states no total, a full page may have others after it: one task reads on until a short one.
        stated = "recordsFiltered" in first or "recordsTotal" in first or len(rows) < self.size
        count = -(-total // self.size) if stated else MOST_PAGES
        count = count if self.most is None else min(count, self.most)
        step = max(1, -(-count // self.tasks)) if stated else count
        return [Pages(search, a, min(a + step, count), self.interval, **bounds) for a in range(0, count, step)]

    def read(self, part: Pages | None) -> Iterator[tuple]:
        if part is None:  # what Spark hands over where nothing was planned
            return
        ask = answers(self.options, part.interval)
        search = part.search
        for page in range(part.first, part.last):
            rows = check_shape(ask(search, page * self.size, self.size))
            for i, row in enumerate(rows):
                at = delivered(row)
                if (part.since or part.until) and (at is None or not (part.since or "") <= at.isoformat() <= (part.until or "9")):
                    continue
                cnpj = search.cnpj or "".join(filter(str.isdigit, str(row.get("cnpjFundo") or ""))) or None
                yield search.tipo, cnpj, search.id_categoria, search.id_tipo, search.id_especie, at, page * self.size + i, json.dumps(row, ensure_ascii=False)
            if len(rows) < self.size:
                return


class DocumentSource(DataSource):
    """Pages of document metadata as rows: what the request asked for (tipo, cnpj, id_categoria, id_tipo, id_especie),
    entrega (when it was delivered), arrival (its place in the request's order) and value (the record's JSON).

    Options: tipos (comma-separated; a request each), url (the service) or files (a folder of
    stored answers), size, maxPages, tasks (page ranges of a request that are read at once; they
    share one request in `interval` seconds), cursors (JSON, by type or `all`; for streams).
    Filters of equality on tipo, cnpj and the ids, and bounds on entrega, go into the request. A
    filter on what wasn't asked for is null in the rows, as the records don't state ids.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return PageReader(_plain(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return CursorReader(_plain(self.options))


def _plain(options) -> dict:
    return {k.lower(): v for k, v in dict(options).items()}


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.planner = Planner(options)
        self.searches = [Search(t) for t in options["tipos"].split(",")]

    def _all(self, **asked) -> None:
        self.searches = [replace(s, **asked) for s in self.searches]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "tipo" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.searches = [s for s in self.searches if s.tipo in wanted]
            elif name in ("cnpj", "id_categoria", "id_tipo", "id_especie") and isinstance(f, EqualTo) and all(getattr(s, name) is None for s in self.searches):
                self._all(**{name: f.value})
            else:
                bounds = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
                if name == "entrega" and isinstance(f, bounds) and isinstance(f.value, dt.datetime):
                    # The request knows days alone, so Spark tests the time again.
                    own = f.value.replace(tzinfo=None)
                    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                        latest = max([own, *[dt.datetime.strptime(s.desde, "%d/%m/%Y") for s in self.searches if s.desde]])
                        self._all(desde=day_text(latest))
                    elif isinstance(f, (LessThan, LessThanOrEqual)):
                        first = min([own, *[dt.datetime.strptime(s.ate, "%d/%m/%Y") for s in self.searches if s.ate]])
                        self._all(ate=day_text(first))
                yield f

    def partitions(self) -> list[Pages]:
        ask = answers(self.planner.options, self.planner.interval)
        return [p for s in self.searches for p in self.planner.plan(s, ask)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.planner.read(partition)


class CursorReader(DataSourceStreamReader):
    """Offsets are cursors: by type, the newest delivery as ISO text, empty before the first."""

    def __init__(self, options: dict):
        self.planner = Planner(options)
        self.tipos = options["tipos"].split(",")
        self.cursors = json.loads(options.get("cursors") or "{}")
        self.categoria = int(options["id_categoria"]) if "id_categoria" in options else None
        self.seen: dict[str, str] = {}

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        """The stored cursors: a type's own, else the one of all types that older stores have."""
        return {t: self.cursors.get(t) or self.cursors.get("all") or "" for t in self.tipos}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        """The newest delivery of each type. A type that can't be asked keeps its offset; it is an error if none can."""
        ask = answers(self.planner.options, self.planner.interval)
        now, failed = {}, []
        for t in self.tipos:
            try:
                newest = [delivered(r) for r in check_shape(ask(Search(t, id_categoria=self.categoria, ordem="desc"), 0, 1))]
                now[t] = max((d.isoformat() for d in newest if d), default="")
            except Exception as exc:  # noqa: BLE001  the other types go on
                failed.append(exc)
                now[t] = ""
        if len(failed) == len(self.tipos):
            raise ExceptionGroup("no type could be asked", failed)
        self.seen = {t: max(now[t], self.seen.get(t, self.initialOffset()[t])) for t in self.tipos}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        ask = answers(self.planner.options, self.planner.interval)
        found = []
        for t in self.tipos:
            begin, stop = start.get(t, ""), end.get(t, "")
            if stop <= begin:
                continue
            since = (dt.datetime.fromisoformat(begin) - OVERLAP) if begin else None
            search = Search(t, id_categoria=self.categoria, desde=day_text(since) if since else None, ate=day_text(dt.datetime.fromisoformat(stop)))
            found += self.planner.plan(search, ask, since=since.isoformat() if since else None, until=stop)
        return found

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.planner.read(partition)


def register(spark: SparkSession) -> None:
    """Makes the format `documents` known, with its filters pushed down."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
