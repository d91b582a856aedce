"""Nested configurations for external workflows."""

from __future__ import annotations

import re
from copy import deepcopy

from ..functions.geodesy import zone_of

#: The groups an interferogram workflow expects; callers merge their own over it.
DEFAULT = {
    "runconfig": {
        "name": "INSAR_RUNCONFIG",
        "groups": {
            "input_file_group": {"reference_rslc_file": None, "secondary_rslc_file": None},
            "dynamic_ancillary_file_group": {"dem_file": None},
            "product_path_group": {"product_path": None, "scratch_path": None, "sas_output_file": None},
            "processing": {"input_subset": {"list_of_frequencies": {"A": ["HH"]}}, "geocode": {"output_epsg": None, "top_left": {"x_abs": None, "y_abs": None}, "bottom_right": {"x_abs": None, "y_abs": None}}},
        },
    }
}


def merge(base: dict, over: dict) -> dict:
    """``base`` with ``over`` merged in, mapping by mapping; neither is changed."""
    out = deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def put(config: dict, dotted: str, value: object) -> dict:
    """``config`` with the value at a dotted path."""
    first, _, rest = dotted.partition(".")
    return merge(config, {first: put({}, rest, value) if rest else value})


def utm_of(wkt: str) -> int:
    """The UTM code of a polygon's middle; latitude 0 is north."""
    xy = [tuple(map(float, p)) for p in re.findall(r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)", wkt)]
    lon, lat = (sum(p[k] for p in xy[:-1]) / max(len(xy) - 1, 1) for k in (0, 1))
    return (32600 if lat >= 0 else 32700) + int((lon + 180) / 6) + 1


def interferogram(reference: str, secondary: str, dem: str, out: str, epsg: int, box: tuple[float, float, float, float], over: dict | None = None, base: dict | None = None) -> dict:
    """The configuration of a pair's interferogram: ``base`` (DEFAULT), the run's own paths and grid, then ``over``."""
    zone_of(epsg)  # raises for codes that are no UTM zone
    own = {
        "input_file_group": {"reference_rslc_file": reference, "secondary_rslc_file": secondary, "qa_gunw_input_file": f"{out}/product.h5"},
        "dynamic_ancillary_file_group": {"dem_file": dem},
        "product_path_group": {"product_path": out, "scratch_path": f"{out}/scratch", "sas_output_file": f"{out}/product.h5", "qa_output_dir": f"{out}/qa_insar"},
        "logging": {"path": f"{out}/scratch/insar.log"},
        "processing": {"radar_grid_cubes": {"output_epsg": epsg}, "geocode": {"output_epsg": epsg, "top_left": {"x_abs": box[0], "y_abs": box[3]}, "bottom_right": {"x_abs": box[2], "y_abs": box[1]}}},
    }
    return merge(merge(DEFAULT if base is None else base, {"runconfig": {"groups": own}}), over or {})
