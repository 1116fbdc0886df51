"""pulsegrid: social-media trend analytics as composable Spark DataFrame functions."""
