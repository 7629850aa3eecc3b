"""Schemas of the data model and the closed set of measurement statuses."""

from __future__ import annotations

STATUSES = (
    "ok", "no_signal", "insufficient_cell_pixels", "insufficient_fit_pixels", "singular_fit", "non_gaussian_fit",
    "contour_outside_cell", "incomplete_rays", "fit_diverged", "center_outside_cell", "edge_at_cell_border",
    "region_at_cell_border", "at_diameter_limit", "fit_failed", "nonpositive_flux_or_background", "not_finite",
    "edge_offset_at_clip", "page_size", "too_few_holes", "no_center",
)
PAGE_STATUSES = ("ok", "no_holes", "failed")

PAGE = "file string, page int, height int, width int, pixels array<double>, error string"
SEED = "page int, seed_id long, x double, y double"
COMPONENT = "page int, component_id int, x int, y int, w int, h int, area long, cx double, cy double"
MEASUREMENT = (
    "page int, cell_id long, method string, valid boolean, status string, center_x double, center_y double, "
    "metrics map<string,double>, contour array<struct<x:double,y:double>>"
)
LATTICE = "page int, seed_id long, row_idx long, col_idx long, indexed boolean"
SPECTRUM = "series string, frequency double, amplitude double, period double"
