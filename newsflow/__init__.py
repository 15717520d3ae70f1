"""newsflow: news headlines and market prices to scored, enriched and evaluated signals, on Spark."""
