from margincast.streaming.cube_stream import (latest_version, run_available, week_window,
                                              weekly_cube_stream)

__all__ = ["weekly_cube_stream", "week_window", "run_available", "latest_version"]
