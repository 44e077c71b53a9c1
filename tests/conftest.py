from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pictures import picture, png_bytes

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sievemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def image_tree(tmp_path_factory) -> Path:
    """Pictures of waves in folders by instrument; one folder has another spelling, and odd files lie about."""
    root = tmp_path_factory.mktemp("waves")

    def put(place: str, data: bytes) -> None:
        path = root / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    for k, folder in enumerate(("Drum", "Flute", "Violine")):
        for i in range(3):
            put(f"{'validation' if i == 2 else 'training'}/{folder}/take-{k}{i}.png", png_bytes(picture(50 + 10 * k + i)))
    put("training/Drum/take-00 (3).png", png_bytes(picture(50)))  # a copy within its class
    put("validation/Flute/borrowed.png", png_bytes(picture(51)))  # a copy in another class
    put("training/Flute/upside.png", png_bytes(picture(61)[::-1]))  # turned, so only near
    put("training/Drum/nothing.png", b"")
    put("training/Drum/half.png", png_bytes(picture(90))[:1500])
    put("training/Drum/stamp.png", png_bytes(picture(91, 20, 30)))
    put("training/Kazoo/solo.png", png_bytes(picture(92)))
    put("training/__MACOSX/ghost.png", png_bytes(picture(93)))
    put("training/Drum/score.csv", b"a,b")
    return root
