"""Spark jobs over a media-production lake: photo and project catalogues, tags, presets,
tenants, device fleets and the health, audit and upload logs around them."""
