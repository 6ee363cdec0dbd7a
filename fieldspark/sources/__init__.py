"""Tables in and out: points, boundaries, rasters, detections."""
