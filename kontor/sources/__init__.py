"""Sources and sinks: landed JSON documents, CSV export grids, adapter views."""
