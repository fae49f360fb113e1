"""Which columns of a table play which part in the screening."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class MeasurementSpec:
    """Column names and class values; every operator takes one of these.

    ``row_key`` names the columns that identify a row. Where a record id may
    repeat, point it at a surrogate key: ordered selections, fold assignment
    and joins between results use it.
    """

    id_col: str = "Test_ID"
    label_col: str = "Validity_Label"
    target_col: str = "Reference_Parameter"
    positive: str = "Invalid"
    negative: str = "Valid"
    voltage: str = "Applied_Voltage_kV"
    current: str = "Load_Current_A"
    temperature: str = "Ambient_Temperature_C"
    duration: str = "Test_Duration_min"
    sensors: tuple[str, ...] = ("Sensor_S1", "Sensor_S2", "Sensor_S3", "Sensor_S4")
    row_key: tuple[str, ...] = ("Test_ID",)

    @property
    def conditions(self) -> tuple[str, ...]:
        return (self.voltage, self.current, self.temperature, self.duration)

    @property
    def features(self) -> tuple[str, ...]:
        return self.conditions + self.sensors

    @property
    def never_features(self) -> frozenset[str]:
        """Columns that must not reach a feature matrix."""
        return frozenset(
            {self.id_col, self.label_col, self.target_col, "missing_columns", *self.row_key}
        )

    def present(self, df: DataFrame, columns=None) -> list[str]:
        wanted = self.features if columns is None else columns
        return [c for c in wanted if c in df.columns]

    def with_row_key(self, *columns: str) -> "MeasurementSpec":
        return replace(self, row_key=tuple(columns))
