"""Geometry and file name functions."""

from roadgeo.functions.arrow import (
    distance_once,
    st_aswkb,
    st_buffer,
    st_distance,
    st_geomfromwkb,
    st_intersects,
)
from roadgeo.functions.geometry import (
    bbox,
    geometry_literal,
    line_from_vertices,
    parse_wkt,
    st_area,
    st_astext,
    st_centroid,
    st_endpoint,
    st_envelope,
    st_geomfromwkt,
    st_length,
    st_makeline,
    st_numpoints,
    st_point,
    st_startpoint,
    st_x,
    st_y,
)
from roadgeo.functions.text import file_stem, without_last_suffix

__all__ = [n for n in dir() if not n.startswith("_")]
