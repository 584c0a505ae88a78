"""Plan-time configuration: column roles, indicator weights and cut-offs."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Measures of the emissions panel.
FEATURES = (
    "co2", "co2_per_capita", "co2_per_gdp",
    "primary_energy_consumption", "energy_per_capita",
    "methane", "nitrous_oxide", "total_ghg",
    "temperature_change_from_ghg",
    "coal_co2", "oil_co2", "gas_co2",
    "land_use_change_co2", "share_global_co2",
)

# Default keys of the comparison reports.
KEY_COUNTRIES = (
    "United States", "China", "India", "Germany",
    "United Kingdom", "Brazil", "Russia", "Japan",
    "Canada", "Australia", "France", "South Africa",
)

# Inputs of the multivariate anomaly detectors.
ANOMALY_FEATURES = (
    "co2", "co2_per_capita", "co2_yoy_change",
    "temperature_change_from_ghg", "fossil_ratio",
    "primary_energy_consumption",
)

# Metrics a report may be asked for.
REPORT_METRICS = (
    "co2", "co2_per_capita", "primary_energy_consumption",
    "temperature_change_from_ghg", "total_ghg",
)

# Columns of the summary, correlation and distribution reports.
SUMMARY_COLUMNS = (
    "co2", "co2_per_capita", "primary_energy_consumption",
    "temperature_change_from_ghg", "total_ghg", "methane",
    "coal_co2", "oil_co2", "gas_co2",
)
CORRELATION_COLUMNS = (
    "co2", "co2_per_capita", "primary_energy_consumption",
    "temperature_change_from_ghg", "methane", "total_ghg", "gdp",
)
DISTRIBUTION_COLUMNS = (
    "co2", "co2_per_capita", "primary_energy_consumption",
    "temperature_change_from_ghg", "methane", "total_ghg",
)
SOURCE_COLUMNS = ("coal_co2", "oil_co2", "gas_co2", "land_use_change_co2")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel: one row per (key, time), integer time.

    ``span`` is the number of periods in one chunk of a key's series. Every
    per-key window runs on (key, chunk) groups, so no task holds more than
    ``span`` rows (plus a short look-back) of a key, whatever its share of the
    table is. Raise it for a sparse time axis, lower it for wide rows.
    """

    key: str = "country"
    time: str = "year"
    code: str = "iso_code"
    passive: tuple[str, ...] = ("population", "gdp")
    features: tuple[str, ...] = FEATURES
    span: int = 65_536

    def ids(self) -> list[str]:
        return [self.key, self.code, self.time]

    def present(self, columns: list[str]) -> list[str]:
        return [c for c in self.features if c in columns]

    def with_span(self, span: int) -> "PanelSpec":
        return replace(self, span=span)


@dataclass(frozen=True)
class Indicator:
    name: str
    column: str
    weight: float
    lower_is_better: bool = True


@dataclass(frozen=True)
class Pillar:
    name: str
    columns: tuple[str, ...]
    weight: float
    lower_is_better: bool = True


# Indicator weights and pillar composition.
INDICATORS = (
    Indicator("CO₂ per Capita", "co2_per_capita", 0.25),
    Indicator("Total GHG per Capita", "ghg_per_capita", 0.20),
    Indicator("CO₂ Intensity (GDP)", "co2_per_gdp", 0.15),
    Indicator("Fossil Fuel Ratio", "fossil_ratio", 0.15),
    Indicator("Energy per Capita", "energy_per_capita", 0.10),
    Indicator("Methane per Capita", "methane_per_capita", 0.08),
    Indicator("Temperature Δ (GHG)", "temperature_change_from_ghg", 0.07),
)
PILLARS = (
    Pillar("Climate", ("co2_per_capita", "temperature_change_from_ghg", "methane_per_capita"), 0.40),
    Pillar("Energy", ("energy_per_capita", "fossil_ratio"), 0.30),
    Pillar("Economy", ("co2_per_gdp", "co2_intensity"), 0.20),
    Pillar("Land Use", ("land_use_change_co2",), 0.10),
)

# Lower score bound, grade and label, best first.
GRADES = (
    (80.0, "A", "Excellent 🌿"),
    (65.0, "B", "Good 🌱"),
    (50.0, "C", "Moderate ⚠️"),
    (35.0, "D", "Poor 🔴"),
    (None, "F", "Critical 🚨"),
)

# Forest score below the bound has the severity, strictest first.
SCORE_SEVERITY = ((-0.35, "critical"), (-0.20, "high"), (-0.10, "medium"))
SEVERITY_ORDER = ("critical", "high", "medium", "normal")

TREND_CLAMP = 5
TREND_FACTOR = "0.3"
EMPTY_SCORE = 50.0
