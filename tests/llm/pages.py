"""Hand-written pages in the manner of real sites, with the text of their article.
They share no generator with the model's own training pages."""

PAGES = {
    "blog": (
        """<!doctype html><html lang="en"><head><title>On bees</title><link rel="stylesheet" href="/s.css"><script>window.x = "<p>no</p>";</script></head>
<body class="single-post"><a class="skip-link" href="#content">Skip to content</a>
<div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Field Notes</a></p><p class="site-description">Slow writing</p></div>
<nav class="main-navigation"><ul id="primary-menu" class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-81" class="post-81 post type-post hentry"><header class="entry-header"><h1 class="entry-title">On bees</h1></header>
<div class="entry-content"><p>The hive in the garden survived its third winter, which surprised everyone who had looked at it in November.</p>
<p>We counted the dead on the landing board each morning &mdash; never more than forty &amp; rarely fewer than five.</p><h2>What we changed</h2><ul><li>The entrance was narrowed in October.</li><li>Sugar was given only twice.</li></ul>
<blockquote><p>A colony is a slow animal.</p></blockquote><p>In spring the queen was still laying, and by May the <em>second</em> box was full of brood.</p></div></article></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent posts</h2><ul><li><a href="/p1">On moths</a></li><li><a href="/p2">On rain</a></li></ul></section></aside></div>
<section id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Lovely, thank you for the numbers.</p></li><li class="comment"><p>Mine died in January, sadly.</p></li></ol>
<form class="comment-form"><label>Name</label><input name="author"><textarea name="comment"></textarea><button>Post comment</button></form></section>
<footer class="site-footer"><p>&copy; 2024 Field Notes. All rights reserved.</p></footer></div></body></html>""",
        """On bees
The hive in the garden survived its third winter, which surprised everyone who had looked at it in November.
We counted the dead on the landing board each morning — never more than forty & rarely fewer than five.
What we changed
The entrance was narrowed in October.
Sugar was given only twice.
A colony is a slow animal.
In spring the queen was still laying, and by May the second box was full of brood.""",
    ),
    "news": (
        """<html><head><title>Bridge reopens</title><meta name=viewport content="width=device-width"></head><body>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience. By staying you accept them.</p><button>Accept</button></div>
<div class="topbar"><a href="/">City Gazette</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a></div>
<div class="ad-slot">Buy two tyres and get two free this weekend only at Rapid Tyres.</div>
<div class="story-body"><h1>Bridge reopens after eleven months</h1>
<figure><img src="b.jpg"><figcaption>The bridge on Tuesday morning.</figcaption></figure>
<p>The old river bridge was opened to traffic again on Tuesday, eleven months after cracks had been found in two of its piers.</p>
<p>Engineers replaced both piers and strengthened the deck with steel plates, a job that cost nine million, about two million more than planned.</p>
<div class="related-links"><h3>More on this</h3><ul><li><a href="/a">Why the bridge was closed</a></li><li><a href="/b">The detour in maps</a></li></ul></div>
<p>Buses return to the route from Monday. Lorries above twelve tonnes stay banned until the inspection in autumn.</p></div>
<div class="newsletter-signup"><p>Get the morning briefing in your inbox.</p><form><input type=email><button>Sign up</button></form></div>
<div id="footer"><ul><li><a href="/terms">Terms</a></li><li><a href="/privacy">Privacy</a></li></ul><p>City Gazette Ltd, 4 Market Street.</p></div></body></html>""",
        """Bridge reopens after eleven months
The bridge on Tuesday morning.
The old river bridge was opened to traffic again on Tuesday, eleven months after cracks had been found in two of its piers.
Engineers replaced both piers and strengthened the deck with steel plates, a job that cost nine million, about two million more than planned.
Buses return to the route from Monday. Lorries above twelve tonnes stay banned until the inspection in autumn.""",
    ),
    "docs": (
        """<!DOCTYPE html><html><head><title>Quick start</title><style>.toc{float:left}</style></head><body>
<nav aria-label="Main"><a href="/">Docs</a><a href="/api">API</a><a href="/faq">FAQ</a></nav>
<div class="sidebar"><ul class="toc"><li><a href="#install">Install</a></li><li><a href="#run">Run</a></li><li><a href="#faq">Questions</a></li></ul></div>
<main role="main"><h1 id="quick-start">Quick start</h1><p>This page shows how to install the tool and how to run it for the first time.</p>
<h2 id="install">Install</h2><pre><code>tool get latest</code></pre><p>The command writes to <code>/opt/tool</code> unless <code>PREFIX</code> is set.</p>
<table><thead><tr><th>Option</th><th>Meaning</th></tr></thead><tbody><tr><td>-q</td><td>say less</td></tr><tr><td>-v</td><td>say more</td></tr></tbody></table>
<h2 id="run">Run</h2><ol><li>Make a folder.</li><li>Put your files into it.</li><li>Call the tool without arguments.</li></ol>
<svg width="10" height="10"><g><svg><title>inner</title></svg><text>icon</text></g></svg><p>The exit code is zero if all files were read.</p></main>
<footer><p>Built with care. Licensed under the terms below.</p></footer></body></html>""",
        """Quick start
This page shows how to install the tool and how to run it for the first time.
Install
tool get latest
The command writes to /opt/tool unless PREFIX is set.
Option
Meaning
-q
say less
-v
say more
Run
Make a folder.
Put your files into it.
Call the tool without arguments.
The exit code is zero if all files were read.""",
    ),
    "wiki": (
        """<html><head><title>Lake Mira</title></head><body><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">Lake Mira</h1>
<div id="bodyContent"><p><b>Lake Mira</b> is a mountain lake at 1,840 metres. It is fed by two glaciers and drained by the river Osa.</p>
<p>Its surface freezes from December to April. The water is clear down to fourteen metres in late summer.</p>
<h2>History</h2><p>The first map that shows the lake was drawn in 1702 by a surveyor who never saw it. A road reached its shore only in 1931.</p>
<h2>Wildlife</h2><p>Char and trout were set out in the nineteenth century; both still breed in the northern bay.</p></div></div>
<div id="mw-navigation"><div class="portlet" role="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li><li><a href="/d">Donate</a></li></ul></div></div>
<div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        """Lake Mira
Lake Mira is a mountain lake at 1,840 metres. It is fed by two glaciers and drained by the river Osa.
Its surface freezes from December to April. The water is clear down to fourteen metres in late summer.
History
The first map that shows the lake was drawn in 1702 by a surveyor who never saw it. A road reached its shore only in 1931.
Wildlife
Char and trout were set out in the nineteenth century; both still breed in the northern bay.""",
    ),
    "shop": (
        """<html><body><header class="header"><div class="logo">Lamps &amp; Co</div><form class="search"><input name=q placeholder="Search"><button>Go</button></form></header>
<ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/l">Lamps</a></li><li>Guide</li></ol>
<article class="content"><h1>How to choose a reading lamp</h1><p>A reading lamp should light the page and not the eye. Put it behind your shoulder, a little above it.</p>
<p>Warm light is easier in the evening; for drawing, choose a lamp of at least ninety in colour rendering.</p><noscript>Please switch on scripts.</noscript>
<p>Price says little: two of the three best lamps of our test cost less than forty.</p></article>
<div class="promo-box"><h3>Deal of the day</h3><p>Desk lamp Orion, now 20 percent off while stocks last.</p></div>
<div class="comments"><p class="reply">I bought the Orion and it broke.</p></div><footer>Lamps &amp; Co, imprint, contact</footer></body></html>""",
        """How to choose a reading lamp
A reading lamp should light the page and not the eye. Put it behind your shoulder, a little above it.
Warm light is easier in the evening; for drawing, choose a lamp of at least ninety in colour rendering.
Price says little: two of the three best lamps of our test cost less than forty.""",
    ),
    "tables": (
        """<HTML><BODY BGCOLOR="#ffffff"><TABLE WIDTH="100%"><TR><TD CLASS="menu" WIDTH=120><A HREF="a.html">Index</A><BR><A HREF="b.html">Links</A><BR><A HREF="c.html">Guestbook</A></TD>
<TD><DIV CLASS="content"><H1>My trip to the coast</H1><P>We left at six in the morning and had breakfast in a harbour where the boats lay on the mud.
<P>The path along the cliffs took four hours. There was no one but us, two dogs and a man who sold lemonade.
<P>In the evening it rained so hard that the tent came down, and we slept in the car.</DIV></TD></TR></TABLE><DIV CLASS="footer">Last updated 1999</DIV></BODY></HTML>""",
        """My trip to the coast
We left at six in the morning and had breakfast in a harbour where the boats lay on the mud.
The path along the cliffs took four hours. There was no one but us, two dogs and a man who sold lemonade.
In the evening it rained so hard that the tent came down, and we slept in the car.""",
    ),
    "magazine": (
        """<html><head><title>x</title></head><body><div class="wrapper"><div class="navbar"><ul><li><a href="/">Start</a><li><a href="/k">Kultur</a><li><a href="/w">Wissen</a></ul></div>
<main><article class="article"><header><h1>Die Rückkehr der Störche</h1></header><p class="intro">Seit zehn Jahren brüten wieder Störche im Tal. Was sich geändert hat, erklärt eine Biologin.</p>
<p>„Die Wiesen sind nasser geworden“, sagt sie, „und damit gibt es wieder genug Frösche.“ Der Bach wurde 2012 aus seinem Betonbett geholt.</p>
<div class="ad"><p>Anzeige: Jetzt Ökostrom testen und sparen.</p></div><h2>Ein Nest auf der Kirche</h2><p>Das erste Paar baute auf dem Kirchturm. Im letzten Sommer waren es elf Nester mit vierundzwanzig Jungen.</p></article>
<section class="recommended"><h2>Lesen Sie auch</h2><ul><li><a href="/1">Der Biber als Nachbar</a></li><li><a href="/2">Neue Auen</a></li></ul></section></main>
<footer class="page-footer"><p>Impressum und Datenschutz</p></footer></div></body></html>""",
        """Die Rückkehr der Störche
Seit zehn Jahren brüten wieder Störche im Tal. Was sich geändert hat, erklärt eine Biologin.
„Die Wiesen sind nasser geworden“, sagt sie, „und damit gibt es wieder genug Frösche.“ Der Bach wurde 2012 aus seinem Betonbett geholt.
Ein Nest auf der Kirche
Das erste Paar baute auf dem Kirchturm. Im letzten Sommer waren es elf Nester mit vierundzwanzig Jungen.""",
    ),
    "plain": (
        """<html><head><title>Letter</title></head><body><h1>A letter to the board</h1><p>Dear members, the roof of the hall leaks again, as it did in 2015 and in 2019.</p><p>I ask for a vote on the repair before the winter.</p><p>With kind regards, the caretaker</p></body></html>""",
        """A letter to the board
Dear members, the roof of the hall leaks again, as it did in 2015 and in 2019.
I ask for a vote on the repair before the winter.
With kind regards, the caretaker""",
    ),
}
