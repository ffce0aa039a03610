"""Relational operators over products, observations and daily series.

Each raw price row belongs to one listing, and every listing attribute depends
on the listing alone. So whatever is asked per product is first folded per
listing on the map side, before the join and before any shuffle by product: a
product holding a third of all rows leaves each map task as one row (or one
row per day). Windows run on the daily series only, where a product has at
most one row per calendar day.
"""
