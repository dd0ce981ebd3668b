"""Pore and particle analytics over many rasters, written as Spark DataFrame operators.

Tables the operators pass along:

scanlines   (image_id, height, width, y, v ARRAY)                     one row per raster row
masks       (image_id, height, width, y, runs ARRAY<STRUCT<x0,x1>>)   one row per raster row, x1 exclusive
label runs  (image_id, height, width, y, x0, x1, label)               foreground only
pores       one row per (image_index, label), columns of ``poremetry.operators.measure.PORE_COLUMNS``

Every row carries its frame size, so no operator has to join a dimension table to find the border.
"""
