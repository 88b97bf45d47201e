"""The same transforms over file streams."""
