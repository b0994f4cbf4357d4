"""Pages written by hand, in layouts and languages that the training pages do not have: {braces} mark the main text."""

import html
import re
import tracemalloc

import pytest

pytest.importorskip("larkspur.llm.html_text")
from larkspur.llm import html_text  # noqa: E402

PAGES = {
    "policy": """<html><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article class='comment-policy story'>
        <h1>{Our policy}</h1><p>{We welcome remarks from everyone who reads this site.}</p><p>{They are moderated by two people, and we answer most of them.}</p>
        </article><footer>&copy; 2020</footer></body></html>""",
    "german": """<html><body><div class=kopf><a href=/>Startseite</a> <a href=/p>Politik</a></div><div class=inhalt><h1>{Neue Brücke eröffnet}</h1>
        <p>{Die neue Brücke über den Fluss wurde gestern eröffnet. Viele Leute kamen zu der Feier.}</p><p>{Der Bau dauerte drei Jahre und kostete weniger als geplant.}</p></div>
        <div id=kommentare><h3>Kommentare</h3><p>Toller Artikel, danke!</p><p>Das war auch Zeit.</p></div><div class=fuss>Impressum Datenschutz</div></body></html>""",
    "french table": """<html><body><table><tr><td class=g><a href=1>Accueil</a><br><a href=2>Nouvelles</a></td><td><h2>{Le pont}</h2>
        <p>{Le nouveau pont a été ouvert hier par le maire de la ville. Beaucoup de gens sont venus.}</p><p>{Les travaux ont duré trois ans, et le prix est resté bas.}</p></td>
        <td><p><a href=3>Lire aussi: la gare</a></p></td></tr></table></body></html>""",
    "spanish sections": """<html><body><section class=cabecera><a href=/>Inicio</a></section><section><h1>{El puente}</h1><p>{El puente nuevo se abrió ayer, y mucha gente vino a verlo desde temprano.}</p>
        <ul><li>{Costó menos de lo previsto.}</li><li>{Duró tres años.}</li></ul><p>{El alcalde habló durante una hora ante los vecinos, que esperaban al sol.}</p></section>
        <section class=relacionados><a href=1>La estación</a><a href=2>El mercado</a></section><section class=pie>Todos los derechos reservados</section></body></html>""",
    "japanese": """<html><body><nav><a href=/>ホーム</a></nav><main><h1>{新しい橋}</h1><p>{昨日、川にかかる新しい橋が開通した。 多くの人が集まった。 市長も話した。}</p><p>{工事は三年かかった。 費用は予定より少なかった。}</p></main><footer>© 2021 会社</footer></body></html>""",
    "blog divs": """<html><body><div id=w><div id=top><a href=/>A small blog</a></div><div id=c1><div class=x7><h2>{On keeping bees}</h2><p>{I have kept bees for nine years now, and every spring I forget the same thing.}</p>
        <blockquote>{A hive is a town with one mind, my grandfather used to say.}</blockquote><p>{He was wrong about most things, but not about that, as I found out last week.}</p></div></div>
        <div id=c2><h4>Archive</h4><ul><li><a href=1>May</a><li><a href=2>April</a><li><a href=3>March</a></ul></div></div></body></html>""",
    "docs": """<html><body><header><a href=/>Docs</a></header><aside class=sidebar><ul><li><a href=1>Install</a><li><a href=2>Configure</a></ul></aside><main class=content><h1>{Install}</h1>
        <p>{Download the archive for your system and unpack it into a folder of your choice.}</p><pre>{tar xf tool.tar}</pre><h2>{Next steps}</h2><p>{Read the guide on settings before you start the server for the first time.}</p></main></body></html>""",
    "news": """<html><body><div class="cookie-banner"><p>We use cookies to make this site work. You can turn them off at any time.</p></div><div role=navigation><a href=1>World</a><a href=2>Sport</a></div>
        <div class="story-body"><h1>{Ferry returns after storm}</h1><p>{The ferry to the islands sailed again on Monday, two days after the storm had passed.}</p><div class="ad-slot"><p>Advertisement</p></div>
        <p>{Passengers who had waited in the harbour hall were given tea, blankets and a free ticket.}</p><p>{The captain said the sea was calm.}</p></div>
        <div class="comments-area"><h3>3 comments</h3><article class=comment><p>I was on that boat. It was fine.</p></article><article class=comment><p>Why two days?</p></article></div></body></html>""",
    "polish": """<html><body><div class=menu><a href=/>Start</a> <a href=/x>Sport</a></div><div class=tresc><h1>{Nowy most otwarty}</h1><p>{Nowy most na rzece otwarto wczoraj. Przyszło wielu ludzi, choć padało.}</p><p>{Budowa trwała trzy lata i kosztowała mniej, niż planowano.}</p></div>
<div id=komentarze><h3>Komentarze</h3><div class=wpis><b>Ola</b><p>Bardzo dobry tekst.</p></div><div class=wpis><b>Jan</b><p>Nareszcie! Czekałem na to.</p></div><div class=wpis><b>Ewa</b><p>Most jest brzydki.</p></div></div><div class=stopka>Wszelkie prawa zastrzeżone</div></body></html>""",
    "recipe": """<html><body><nav><a href=1>Home</a><a href=2>Recipes</a></nav><main><h1>{Butter biscuits}</h1><p>{Subscribe to no one: these cookies need only flour, butter and a little sugar.}</p><ul><li>{200 g flour}</li><li>{100 g butter}</li><li>{50 g sugar}</li></ul><p>{Mix, rest for an hour and bake for twelve minutes.}</p><p>{Read more about butter below.}</p>
<p>{Good butter is soft and pale, and it smells of grass. Buy it from a farm.}</p></main><div class=reviews><h2>Reviews</h2><div class=review><p>Lovely and easy.</p></div><div class=review><p>Mine burned. Ten minutes is enough.</p></div></div><footer>All rights reserved</footer></body></html>""",
    "teasers": """<html><body><header><a href=/>News</a></header><article><h1>{Rain}</h1><p>{It rained for nine days, and the river rose to the old mark on the mill.}</p><p>{Nobody was hurt. The mill stands, as it has for two hundred years.}</p></article>
<section><h2>More from us</h2><div class=t><a href=1>Snow in May</a><p>A cold spring surprises the valley.</p></div><div class=t><a href=2>Wind</a><p>Roofs were torn off.</p></div><div class=t><a href=3>Fog</a><p>The airport is closed.</p></div></section></body></html>""",
    "dutch": """<html><body><div id=kop><a href=/>Krant</a></div><div id=midden><h1>{De brug is open}</h1><p>{De nieuwe brug over de rivier is gisteren geopend. Er kwamen veel mensen.}</p><p>{De bouw duurde drie jaar, en dat was langer dan gepland.}</p><p>{Volgend jaar komt er een tweede brug.}</p></div><div id=reacties><h3>Reacties</h3><ul><li><p>Mooi werk.</p></li><li><p>Veel te duur!</p></li></ul></div><div id=voet>Contact Adverteren Colofon</div></body></html>""",
    "russian": """<html><body><ul><li><a href=1>Главная</a><li><a href=2>Новости</a></ul><div class=text><h1>{Новый мост}</h1><p>{Вчера через реку открыли новый мост. Пришло много людей, хотя шёл дождь.}</p><p>{Строительство длилось три года и стоило меньше, чем ожидали.}</p></div><div class=niz>© 2020 Газета</div></body></html>""",
    "italian": """<html><body><div class=testata><a href=/>Giornale</a></div><article><h1>{Il ponte}</h1><p>{Il nuovo ponte è stato aperto ieri dal sindaco. La gente è venuta presto.}</p><aside><p>Leggi anche: la stazione</p></aside><p>{I lavori sono durati tre anni, e il prezzo è rimasto basso.}</p></article><div class=commenti><p>Bravo!</p><p>Era ora.</p></div><footer>Tutti i diritti riservati</footer></body></html>""",
    "portuguese": """<html><body><div class=topo><a href=/>Jornal</a></div><div class=corpo><h1>{A ponte}</h1><p>{A nova ponte foi aberta ontem pelo prefeito. Muita gente veio cedo para ver.}</p><p>{As obras duraram três anos, e o preço ficou abaixo do previsto.}</p></div><div class=rodape>Todos os direitos reservados</div></body></html>""",
    "swedish": """<html><body><nav><a href=/>Hem</a><a href=/n>Nyheter</a></nav><article><h1>{Bron är öppen}</h1><p>{Den nya bron öppnades i går. Många kom, trots att det regnade hela dagen.}</p><p>{Bygget tog tre år och kostade mindre än planerat.}</p></article><div class=svar><div class=s1><b>Eva</b><p>Fin bro!</p></div><div class=s1><b>Nils</b><p>Äntligen.</p></div></div></body></html>""",
}


def test_pages_of_other_layouts():
    model, wrong, total = html_text.trained(), [], 0
    for name, page in PAGES.items():
        blocks = html_text.leaf_blocks(page)
        labels = model.decode(html_text.block_features(blocks))
        total += len(blocks)
        wrong += [(name, text) for (_, text, *_), y in zip(blocks, labels, strict=True) if (text[0] == "{") != bool(y)]
    assert len(wrong) <= 0.05 * total, wrong
    for name in ("policy", "german", "recipe", "polish", "dutch"):
        want = "\n".join(re.findall(r"\{(.*?)\}", PAGES[name]))
        assert html_text.main_text(re.sub(r"[{}]", "", PAGES[name]), model) == want


def test_odd_pages(spark):
    page = PAGES["news"]
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", ""), (3, "u", None), (4, "u", "<p>" + "long text here. " * 60_000 + "</p>"), (5, "u", "<div>" * 3000 + "x"), (6, "u", "plain text")]
    table = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract_text(table).collect()
    assert len(got) == len(rows) and got[0]["text"] == got[1]["text"] == got[2]["text"] != ""
    assert got[3]["text"] == got[4]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_text(table.limit(0)).collect() == []


def test_deep_pages_take_no_more_room_than_flat_ones():
    def peak(page: str) -> int:
        tracemalloc.start()
        html_text.block_features(html_text.leaf_blocks(page))
        return tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    sizes = [peak("<div>x" * n)[0] for n in (2000, 8000)]
    assert sizes[1] < 6 * sizes[0]
    assert html_text.main_text("<div>x" * 50_000, html_text.trained()) == html_text.main_text("<div>x" * 50_000 + "</p></b>" * 10, html_text.trained())


def test_given_pages_keep_their_article(spark):
    """Each page of the given table has one article element: its blocks are the text, by a plain reading of the markup."""
    rows = html_text.op4_html_text(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in rows:
        inside = re.search(r"<article[^>]*>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inside = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inside, flags=re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote|table|tr|td)\b[^>]*>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b), r["page_id"]
