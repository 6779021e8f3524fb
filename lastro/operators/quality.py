"""Layout checks that ride on a load: metrics taken while rows are written, with limits that stop it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lastro.functions.parsing import LayoutError

#: Columns of the registry that hold a value in some row at least, or the layout has moved (fixed values).
REGISTRY_FILLED = ("denominacao", "tipo_veiculo", "situacao", "publico_alvo", "administrador")


def observed(rows: DataFrame, columns: tuple[str, ...], name: str) -> tuple[DataFrame, Observation]:
    """rows as they are, and an observation that counts them and each column's values once an action has read them all."""
    seen = Observation(name)
    filled = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *filled), seen


def require(seen: Observation, least: dict[str, float], least_rows: int = 1, what: str = "") -> Callable[[], None]:
    """A check for Store.write and Store.merge: raises LayoutError if too few rows, or shares of filled values, were observed.

    least: a column's share of rows with a value, at least; 0 asks for one value in all rows together.
    """

    def check() -> None:
        got = seen.get
        if got["rows"] < least_rows:
            raise LayoutError(f"{what}: {got['rows']} rows, at least {least_rows} are wanted")
        poor = {c: got[c] / got["rows"] for c, share in least.items() if got[c] == 0 or got[c] < share * got["rows"]}
        if got["rows"] and poor:
            raise LayoutError(f"{what}: columns with too few values (has the layout changed?): {', '.join(f'{c} {x:.1%}' for c, x in sorted(poor.items()))}")

    return check
