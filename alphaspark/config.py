"""Settings as dataclasses, in YAML files."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

VARIABLE = "ALPHASPARK_CONFIG"


@dataclass
class DataConfig:
    source: str = "parquet"
    path: str = "data"
    table: str = "daily_ohlcv"
    start: str | None = None
    end: str | None = None
    symbols: list[str] = field(default_factory=list)


@dataclass
class FactorConfig:
    names: list[str] = field(default_factory=list)
    mode: str = "sql"


@dataclass
class BacktestConfig:
    n_quantiles: int = 5
    periods: list[int] = field(default_factory=lambda: [1, 5, 10])
    method: str = "spearman"


@dataclass
class OutputConfig:
    folder: str = "output"
    html: bool = True


@dataclass
class PipelineConfig:
    data: DataConfig = field(default_factory=DataConfig)
    factor: FactorConfig = field(default_factory=FactorConfig)
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    output: OutputConfig = field(default_factory=OutputConfig)

    @classmethod
    def from_dict(cls, values: dict) -> PipelineConfig:
        out = cls()
        for part in fields(cls):
            own = getattr(out, part.name)
            assert is_dataclass(own)
            for key, value in (values.get(part.name) or {}).items():
                if key not in {f.name for f in fields(own)}:
                    raise ValueError(f"unknown setting {part.name}.{key}")
                setattr(own, key, value)
        return out

    @classmethod
    def from_yaml(cls, path: str) -> PipelineConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False), encoding="utf-8")


def load_config(path: str | None = None) -> PipelineConfig:
    """From ``path``, or the file that ALPHASPARK_CONFIG names; the defaults where there is none."""
    path = path or os.environ.get(VARIABLE)
    return PipelineConfig.from_yaml(path) if path and Path(path).exists() else PipelineConfig()
