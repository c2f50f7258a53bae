import pytest

from tidewatch.schemas import RAW_SWAP_SCHEMA
from tidewatch.session import build_session

POOL = "0x88e6a0c2ddd26feeb64f039a2c41296fcb3f5640"
T0 = 1769263223
PRICE = "1459360160181669463152813566785694"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__session__timeZone="America/New_York",
        # Tables of a few rows: compiling each plan would take longer than running it.
        spark__sql__codegen__wholeStage="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def address(n: int) -> str:
    return f"0x{n:040x}"


def tx(n: int) -> str:
    return f"0x{n:064x}"


def swap(n, sender, seconds, amount0, amount1="0", usd="1000", pool=POOL, price=PRICE, **other):
    """One raw swap; ``n`` numbers its transaction and block."""
    row = {
        "timestamp": str(T0 + seconds),
        "block_number": str(24305113 + n),
        "tx_hash": tx(n),
        "pool": pool,
        "sender": address(sender) if isinstance(sender, int) else sender,
        "recipient": address(99),
        "amount0": str(amount0),
        "amount1": str(amount1),
        "amount_usd": str(usd),
        "tick": "196433",
        "sqrtPriceX96": price,
    }
    row.update(other)
    return row


@pytest.fixture(scope="session")
def table(spark):
    def build(rows):
        return spark.createDataFrame(
            [tuple(row[name] for name in RAW_SWAP_SCHEMA.fieldNames()) for row in rows], RAW_SWAP_SCHEMA
        )

    return build
