"""Operators: functions from DataFrames to a DataFrame.

``scope`` names the tenant columns every join key, group and numbering is prefixed with. Rows that
refer to something are held as link rows (``..., ref``), never as collected arrays, so no group has
to fit into one task; where several rows are needed per key they are first reduced to one row per
key, and the many-rows side of every join is the left one.
"""
