"""pinfold: geospatial entity resolution and corpus preparation as DataFrame operators."""
