"""UTM, geodetic and earth-centred coordinates on WGS84 as staged expressions (Krueger series)."""

from __future__ import annotations

from math import sqrt

from ..plans.stages import Stages, num

# fixed values: WGS84 and UTM
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_n = FLATTENING / (2 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
RECTIFYING = AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
# fixed values: coefficients of the series in the third flattening, to its fourth power
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def zone_of(epsg: int) -> tuple[float, float]:
    """(central meridian in degrees, false northing) of a UTM code; others are an error."""
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} is not a WGS84 UTM zone")
    return epsg % 100 * 6 - 183.0, FALSE_NORTH if epsg // 100 == 327 else 0.0


def _series(coefficients: tuple, f: str, g: str) -> str:
    return " + ".join(f"{num(c)}*{f}({2 * k}*{{a}})*{g}({2 * k}*{{b}})" for k, c in enumerate(coefficients, 1))


def utm_to_lonlat(epsg: int, x: str = "x", y: str = "y") -> Stages:
    """Adds lon, lat in degrees (and the helper columns of the series)."""
    lon0, north = zone_of(epsg)
    k = SCALE * RECTIFYING
    return [
        {"u_xi": f"({y} - {num(north)})/{num(k)}", "u_eta": f"({x} - {num(FALSE_EAST)})/{num(k)}"},
        {
            "v_xi": "u_xi - (" + _series(_BETA, "sin", "cosh").format(a="u_xi", b="u_eta") + ")",
            "v_eta": "u_eta - (" + _series(_BETA, "cos", "sinh").format(a="u_xi", b="u_eta") + ")",
        },
        {"u_chi": "asin(sin(v_xi)/cosh(v_eta))"},
        {
            "lat": "degrees(u_chi + " + " + ".join(f"{num(c)}*sin({2 * j}*u_chi)" for j, c in enumerate(_DELTA, 1)) + ")",
            "lon": f"{num(lon0)} + degrees(atan2(sinh(v_eta), cos(v_xi)))",
        },
    ]


def lonlat_to_utm(epsg: int, lon: str = "lon", lat: str = "lat") -> Stages:
    """Adds east and north in metres."""
    lon0, north = zone_of(epsg)
    e = 2 * sqrt(_n) / (1 + _n)
    k = SCALE * RECTIFYING
    return [
        {"w_t": f"sinh(atanh(sin(radians({lat}))) - {num(e)}*atanh({num(e)}*sin(radians({lat}))))", "w_l": f"radians({lon} - {num(lon0)})"},
        {"w_xi": "atan2(w_t, cos(w_l))", "w_eta": "atanh(sin(w_l)/sqrt(1 + w_t*w_t))"},
        {
            "north": f"{num(north)} + {num(k)}*(w_xi + " + _series(_ALPHA, "sin", "cosh").format(a="w_xi", b="w_eta") + ")",
            "east": f"{num(FALSE_EAST)} + {num(k)}*(w_eta + " + _series(_ALPHA, "cos", "sinh").format(a="w_xi", b="w_eta") + ")",
        },
    ]


def lonlat_to_ecef(lon: str = "lon", lat: str = "lat", h: str = "h") -> Stages:
    """Adds ex, ey, ez in metres."""
    return [
        {"e_n": f"{num(AXIS)}/sqrt(1 - {num(E2)}*sin(radians({lat}))*sin(radians({lat})))"},
        {
            "ex": f"(e_n + {h})*cos(radians({lat}))*cos(radians({lon}))",
            "ey": f"(e_n + {h})*cos(radians({lat}))*sin(radians({lon}))",
            "ez": f"(e_n*{num(1 - E2)} + {h})*sin(radians({lat}))",
        },
    ]


def utm_epsg(lon: str, lat: str) -> str:
    """The UTM code of a point; latitude 0 is north."""
    return f"CAST(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + floor(({lon} + 180)/6) + 1 AS BIGINT)"


def baseline() -> Stages:
    """Adds b_perp, b_par from reference (rx.., velocity vx..), secondary (sx..) and ground (ex..) positions."""
    return [
        {"kx": "sx - rx", "ky": "sy - ry", "kz": "sz - rz", "lx": "rx - ex", "ly": "ry - ey", "lz": "rz - ez"},
        {"l_n": "sqrt(lx*lx + ly*ly + lz*lz)", "v_n": "sqrt(vx*vx + vy*vy + vz*vz)"},
        {f"l{a}u": f"CASE WHEN l_n > 0 THEN l{a}/l_n ELSE 0e0 END" for a in "xyz"} | {f"v{a}u": f"CASE WHEN v_n > 0 THEN v{a}/v_n ELSE 0e0 END" for a in "xyz"},
        {"cx": "vyu*lzu - vzu*lyu", "cy": "vzu*lxu - vxu*lzu", "cz": "vxu*lyu - vyu*lxu"},
        {"c_n": "sqrt(cx*cx + cy*cy + cz*cz)"},
        {"b_perp": "CASE WHEN c_n > 0 THEN (kx*cx + ky*cy + kz*cz)/c_n ELSE 0e0 END", "b_par": "kx*lxu + ky*lyu + kz*lzu"},
    ]
