"""pixelmill: image colour analytics on Spark, pixels as relations."""
